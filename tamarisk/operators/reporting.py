"""Verdicts, interval texts and the guard against claims no test can license."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of forbidden claims, matched whatever the case.
FORBIDDEN = (
    r"\bno[\s\-_]+bias\b",
    r"\bbias[\s\-_]+free\b",
    r"\bunbiased\b",
    r"\bno[\s\-_]+evidence[\s\-_]+of[\s\-_]+bias\b",
    r"\bfair\b(?![\s\-]*(ness|ly))",
)


class ForbiddenClaim(Exception):
    """A text claims what no test can license."""


def forbidden(text: Column) -> Column:
    """Whether a text holds a forbidden claim; null texts don't."""
    found = F.lit(False)
    for p in FORBIDDEN:
        found = found | text.rlike(f"(?iU){p}")
    return F.coalesce(found, F.lit(False))


def guarded(text: Column) -> Column:
    """The text; one with a forbidden claim raises when it is read."""
    return F.when(forbidden(text), F.raise_error(F.lit("the text claims what no test can license")).cast("string")).otherwise(text)


def interval_text(z: float = 1.96) -> Column:
    """mean [low, high] with the clustering named, of a cluster_robust row."""
    low, high = F.col("mean_difference") - z * F.col("se"), F.col("mean_difference") + z * F.col("se")
    return F.format_string("%+.4f [%+.4f, %+.4f] (SE %.4f; %s; n=%d over %d ads x %d pairs)", F.col("mean_difference"), low, high, F.col("se"), F.col("clustering"), F.col("n"), F.col("n_ads"), F.col("n_pairs"))


def verdicts(cells: DataFrame) -> DataFrame:
    """cells (label, achieved_power, power_floor, equivalent, significant) with verdict and reason.

    Power comes first: below its floor a cell is inconclusive, whatever else.
    """
    power = F.col("achieved_power")
    ok = F.coalesce(power.between(0, 1), F.lit(False))
    under = F.when(ok, power < F.col("power_floor")).otherwise(F.raise_error(F.lit("power must lie in [0, 1]")).cast("boolean"))
    out = lambda v, why: F.struct(F.lit(v).alias("verdict"), F.lit(why).alias("reason"))
    v = (
        F.when(under, out("inconclusive", "achieved power is below the floor"))
        .when(F.coalesce("equivalent", F.lit(False)), out("equivalent-within-margin", "both one-sided tests reject"))
        .when(F.coalesce("significant", F.lit(False)), out("difference-detected", "the interval excludes zero"))
        .otherwise(out("inconclusive", "neither a difference nor equivalence was shown"))
    )
    return cells.withColumn("__v", v).select(*cells.columns, "__v.verdict", "__v.reason")


def render(intervals: DataFrame, cells: DataFrame, abstention_rate: float | None = None) -> str:
    """The report as text, guarded; intervals (label, text) sorted by label.

    It goes to the driver: a report has a row per planned cell.
    """
    lines = ["# Results", "", "## Intervals"]
    lines += [f"- **{r.label}**: {r.text}" for r in intervals.orderBy("label").select("label", "text").collect()]
    lines += ["", "## Cell verdicts"]
    for r in cells.orderBy("label").collect():
        lines.append(f"- **{r.label}**: {r.verdict} (power {r.achieved_power:.3f} vs floor {r.power_floor:.3f}): {r.reason}")
    if abstention_rate is not None:
        lines += ["", "## Abstentions", "", f"Abstention rate: {abstention_rate:.4f}. Abstained cues are a category of their own."]
    text = "\n".join([*lines, ""])
    for p in FORBIDDEN:
        if re.search(p, text, re.I):
            raise ForbiddenClaim(p)
    return text

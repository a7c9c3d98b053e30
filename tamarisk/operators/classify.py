"""Thresholds, classification with abstention, and the threshold sweep."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.functions import cues

#: Parts of speech that take the inheritance route, not this one.
TIER_C_POS = ("verb", "adj", "adj_comp")


@dataclass(frozen=True)
class Thresholds:
    """Both required, in [0, 1], low at most high. There are no defaults."""

    high: float
    low: float

    def __post_init__(self) -> None:
        if not 0 <= self.low <= self.high <= 1:
            raise ValueError(f"need 0 <= low <= high <= 1, got low={self.low}, high={self.high}")


def resolve(mass_r: Column, mass_i: Column, high: Column | float, low: Column | float) -> Column:
    """r, i, or null for abstention; a missing mass is 0."""
    high, low = (x if isinstance(x, Column) else F.lit(float(x)) for x in (high, low))
    r, i = F.coalesce(mass_r, F.lit(0.0)), F.coalesce(mass_i, F.lit(0.0))
    return F.when((r >= high) & (i < low), "r").when((i >= high) & (r < low), "i")


def classify(
    df: DataFrame,
    config: Thresholds,
    candidates: str = "candidates",
    pos: str = "pos",
    gen: str = "gen",
    form_gen: str = "form_gen",
    role: str = "role_test_passes",
    strict: bool = False,
) -> DataFrame:
    """df with mass, rationality, tier, referent and abstain_reason.

    In order: verbs and adjectives go another way (tier C; an error if
    ``strict``, else referent PENDING, so that none is lost); candidates of
    both genders abstain (AB4), then diverging form gender (AB5), then an
    unresolved rationality (AB1, tier B); inanimate cues are non_applicant;
    animate ones follow the role test, whose null abstains (AB6).
    A narrow projection: no shuffle.
    """
    p = F.col(pos)
    pending = F.coalesce(p.isin(*TIER_C_POS), F.lit(False))
    if strict:
        message = F.concat(F.lit("tier C isn't implemented (D7, D8): "), F.coalesce(p, F.lit("null")))
        pending = F.when(pending, F.raise_error(message).cast("boolean")).otherwise(False)
    df = df.withColumn("mass", cues.rationality_mass(F.col(candidates)))
    df = df.withColumn("rationality", resolve(F.col("mass.r"), F.col("mass.i"), config.high, config.low))
    role_ = F.col(role) if role in df.columns else F.lit(None).cast("boolean")
    out = lambda tier, referent, reason: F.struct(F.lit(tier).alias("tier"), F.lit(referent).alias("referent"), F.lit(reason).cast("string").alias("abstain_reason"))
    verdict = (
        F.when(pending, out("C", "PENDING", None))
        .when(cues.gender_disagreement(F.col(candidates)), out("A", "ABSTAIN", "AB4"))
        .when(cues.form_divergence(F.col(gen), F.col(form_gen)), out("A", "ABSTAIN", "AB5"))
        .when(F.col("rationality").isNull(), out("B", "ABSTAIN", "AB1"))
        .when(F.col("rationality") == "i", out("A", "non_applicant", None))
        .when(role_.isNull(), out("A", "ABSTAIN", "AB6"))
        .when(role_, out("A", "applicant", None))
        .otherwise(out("A", "non_applicant", None))
    )
    keep = [c for c in df.columns if c not in ("tier", "referent", "abstain_reason")]
    return df.select(*keep, verdict.alias("__v")).select(*keep, "__v.tier", "__v.referent", "__v.abstain_reason")


#: Calibrated cases gathered in one row of a sweep.
CASE_BLOCK = 10_000


def grid(spark: SparkSession, steps: int) -> DataFrame:
    """All pairs of i / steps with theta_low <= theta_high."""
    axis = spark.range(0, steps + 1)
    high, low = axis.select(F.col("id").alias("h")), axis.select(F.col("id").alias("l"))
    pairs = high.join(F.broadcast(low), F.col("l") <= F.col("h"))
    return pairs.select((F.col("h") / steps).alias("theta_high"), (F.col("l") / steps).alias("theta_low"))


def sweep(pairs: DataFrame, cases: DataFrame) -> DataFrame:
    """Whether each case (label, mass_r, mass_i, expected) holds at each pair.

    The result has a row per case and pair, as that is the question. Cases are
    a handful of calibrated fixtures as a rule; they are gathered in one row,
    so that the sweep is a projection of the grid, whatever its size. More than
    ``CASE_BLOCK`` are gathered in rows of about so many, which meet the grid by an equi-join.
    """
    n = cases.count()
    gathered = F.array_sort(F.collect_list(F.struct("label", "mass_r", "mass_i", "expected"))).alias("cases")
    if n <= CASE_BLOCK:
        each = pairs.join(F.broadcast(cases.agg(gathered)))
    else:
        blocks = -(-n // CASE_BLOCK)
        packed = cases.groupBy(F.pmod(F.xxhash64("label", "mass_r", "mass_i"), F.lit(blocks)).alias("block")).agg(gathered)
        each = pairs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))).join(packed, "block").drop("block")
    each = each.withColumn("c", F.explode("cases"))
    got = resolve(F.col("c.mass_r"), F.col("c.mass_i"), F.col("theta_high"), F.col("theta_low"))
    return each.select("theta_high", "theta_low", F.col("c.label").alias("label"), got.eqNullSafe(F.col("c.expected")).alias("ok"))


def feasible(swept: DataFrame) -> DataFrame:
    """The pairs at which every case holds."""
    return swept.groupBy("theta_high", "theta_low").agg(F.bool_and("ok").alias("ok")).where("ok").drop("ok")


def failures(swept: DataFrame) -> DataFrame:
    """How many pairs fail each case."""
    return swept.groupBy("label").agg(F.count_if(~F.col("ok")).alias("n_failures"))


def ranges(pairs: DataFrame) -> DataFrame:
    """One row: the extent of a feasible region, null if it is empty."""
    return pairs.agg(*[f(c).alias(f"{n}_{c}") for c in ("theta_high", "theta_low") for n, f in (("min", F.min), ("max", F.max))])

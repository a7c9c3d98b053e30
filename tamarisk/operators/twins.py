"""Structural comparison of twin texts, set-based over all pairs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FIELDS = {"tier": "tier", "referent": "referent", "abstain_reason": "abstain_trigger"}


def positions(cues: DataFrame, pair: str = "pair_id") -> DataFrame:
    """The cues with their 0-based position within their pair and side (f, m)."""
    order = W.partitionBy(pair, "side").orderBy("token_index", *[c for c in ("tier", "referent", "abstain_reason") if c in cues.columns])
    return cues.where(F.col("side").isin("f", "m")).withColumn("position", F.row_number().over(order) - 1)


def aligned(cues: DataFrame, pair: str = "pair_id") -> DataFrame:
    """f and m cues of the same position side by side, cut to the shorter side."""
    at = positions(cues, pair)
    shape = F.struct("tier", "referent", "abstain_reason", "token_index", "gen")
    sides = at.groupBy(pair, "position").agg(*[F.max(F.when(F.col("side") == s, shape)).alias(s) for s in ("f", "m")])
    return sides.where("f IS NOT NULL AND m IS NOT NULL")


def asymmetries(cues: DataFrame, pair: str = "pair_id", compare_index: bool = False) -> DataFrame:
    """(pair, kind, position, value_f, value_m): every difference, no short circuit.

    A difference in the number of cues has position null. One shuffle by pair
    and side, which pre-aggregates to one row per position.
    """
    both = aligned(cues, pair)
    fields = dict(FIELDS) | ({"token_index": "token_index"} if compare_index else {})
    each = [
        F.when(~F.col(f"f.{c}").eqNullSafe(F.col(f"m.{c}")), F.struct(F.lit(kind).alias("kind"), F.col(f"f.{c}").cast("string").alias("value_f"), F.col(f"m.{c}").cast("string").alias("value_m")))
        for c, kind in fields.items()
    ]
    rows = both.select(pair, "position", F.explode(F.array_compact(F.array(*each))).alias("d")).select(pair, "d.kind", "position", "d.value_f", "d.value_m")
    n = counts(cues, pair).where("n_f <> n_m")
    return rows.unionByName(n.select(pair, F.lit("cue_count").alias("kind"), F.lit(None).cast("int").alias("position"), F.col("n_f").cast("string").alias("value_f"), F.col("n_m").cast("string").alias("value_m")))


def counts(cues: DataFrame, pair: str = "pair_id") -> DataFrame:
    return cues.groupBy(pair).agg(F.count_if(F.col("side") == "f").alias("n_f"), F.count_if(F.col("side") == "m").alias("n_m"))


def report(cues: DataFrame, pair: str = "pair_id", compare_index: bool = False) -> DataFrame:
    """One row per pair: n_f, n_m, n_asymmetries, symmetric."""
    found = asymmetries(cues, pair, compare_index).groupBy(pair).agg(F.count("*").alias("n_asymmetries"))
    return counts(cues, pair).join(found, pair, "left").fillna({"n_asymmetries": 0}).withColumn("symmetric", F.col("n_asymmetries") == 0)


def genders_differ(cues: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Per pair: an aligned pair of known genders differs, or f has F and m has M."""
    by_position = aligned(cues, pair).groupBy(pair).agg(F.bool_or(F.col("f.gen") != F.col("m.gen")).alias("aligned"))
    sides = cues.groupBy(pair).agg(
        F.bool_or((F.col("side") == "f") & F.coalesce(F.col("gen") == "f", F.lit(False))).alias("ff"),
        F.bool_or((F.col("side") == "m") & F.coalesce(F.col("gen") == "m", F.lit(False))).alias("mm"),
    )
    return sides.join(by_position, pair, "left").select(pair, (F.coalesce("aligned", F.lit(False)) | (F.col("ff") & F.col("mm"))).alias("genders_differ"))


def describe(reports: DataFrame, pair: str = "pair_id") -> DataFrame:
    """A line of text per pair."""
    bad = F.format_string("%s: ASYMMETRIC (%d differences)", F.col(pair), F.col("n_asymmetries"))
    good = F.format_string("%s: symmetric (%d cues)", F.col(pair), F.col("n_f"))
    return reports.select(pair, F.when(F.col("symmetric"), good).otherwise(bad).alias("text"))

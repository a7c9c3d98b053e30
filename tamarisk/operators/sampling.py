"""Seeded stratified samples with over-sampled error classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarisk.session import broadcast_if_small

#: Rows of one bucket when a stratum is ranked.
BUCKET_ROWS = 10_000


def error_class(token: Column, weights: dict[str, float]) -> Column:
    """The token if it is over-sampled, else null."""
    return F.when(token.isin(*weights), token) if weights else F.lit(None).cast("string")


def _key(fields: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("\\N")) for f in fields])


def quotas(cues: DataFrame, fields: list[str], n: int, weights: dict[str, float]) -> DataFrame:
    """One row per stratum: key, available, quota, take.

    Largest remainders: n times the stratum's weight over the total, floored;
    the rest goes to the largest fractions, ties by key. Strata are few, as
    they are combinations of categories, so they fit one window.
    """
    if n <= 0:
        raise ValueError(f"n must be positive, got {n}")
    rows = cues.withColumn("error_class", error_class(F.col("token"), weights))
    strata = rows.groupBy(*fields, "error_class").agg(F.count("*").alias("available"))
    weight = F.lit(1.0)
    for token, w in sorted(weights.items()):
        weight = F.when(F.col("error_class") == token, w).otherwise(weight)
    strata = strata.withColumn("stratum", _key([*fields, "error_class"])).withColumn("w", F.col("available") * weight)
    everything = W.partitionBy(F.lit(1))
    raw = F.lit(float(n)) * F.col("w") / F.sum("w").over(everything)
    strata = strata.withColumn("raw", F.round(raw, 9)).withColumn("base", F.floor("raw").cast("bigint"))
    by_fraction = everything.orderBy((F.col("raw") - F.col("base")).desc(), "stratum")
    extra = (F.row_number().over(by_fraction) <= F.lit(n) - F.sum("base").over(everything)).cast("bigint")
    out = strata.select("stratum", *fields, "error_class", "available", (F.col("base") + extra).alias("quota"))
    return out.withColumn("take", F.least("quota", "available"))


def shortfalls(plan: DataFrame) -> DataFrame:
    """Strata that hold fewer rows than their quota."""
    return plan.where("take < quota").select("stratum", "quota", "available")


def draw(cues: DataFrame, fields: list[str], n: int, seed: int, weights: dict[str, float], key: str = "cue_id") -> DataFrame:
    """The drawn rows: key and stratum, the same for any order and partitioning.

    Rows are ranked by SHA-256 of seed and key within their stratum. A large
    stratum is first cut to the hash prefix that holds its quota (with a wide
    margin and only where that many rows are there for sure), so no task
    sorts a whole stratum.
    """
    plan = quotas(cues, fields, n, weights)
    rows = cues.withColumn("error_class", error_class(F.col("token"), weights))
    rows = rows.withColumn("stratum", _key([*fields, "error_class"])).withColumn("h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256))
    rows = rows.join(broadcast_if_small(plan.select("stratum", "take", "available")), "stratum").where("take > 0")
    # buckets of the hash space, counted first: only those up to the quota are sorted
    rows = rows.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("available") / BUCKET_ROWS)))
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 2.0**32 * F.col("buckets")))
    sizes = rows.groupBy("stratum", "bucket").agg(F.count("*").alias("size"))
    before = W.partitionBy("stratum").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("stratum", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    rows = rows.join(offsets, ["stratum", "bucket"]).where("offset < take")
    rank = F.row_number().over(W.partitionBy("stratum", "bucket").orderBy("h", key)) + F.col("offset")
    return rows.withColumn("rank", rank).where("rank <= take").select(key, "stratum")

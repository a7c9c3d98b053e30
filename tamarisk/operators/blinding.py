"""Keyed blinding of cells, and a check of their order for leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarisk.functions.text import hmac_sha256, keyed_token
from tamarisk.session import cut


class BlindingError(ValueError):
    """The key can't blind."""


def canonical(register: Column, polarity: Column, pair: Column) -> Column:
    """The cell as text, its parts in fixed order."""
    return F.concat(F.lit("register="), register, F.lit("|polarity="), polarity, F.lit("|pair="), pair)


def _checked(key: bytes) -> bytes:
    if not key:
        raise BlindingError("the key is empty: tokens could be found by trying all cells")
    if len(key) < 16:
        raise BlindingError(f"the key has {len(key)} bytes; 16 are needed against trying all keys")
    return key


def token(cell: Column, key: bytes, length: int = 32, in_plan: bool = False) -> Column:
    """HMAC-SHA256 of the cell, cut to ``length`` hex digits.

    ``in_plan`` computes it from built-ins, with the padded key in the query
    plan; else a UDF holds the key.
    """
    key = _checked(key)
    return F.substring(hmac_sha256(cell, key), 1, length) if in_plan else keyed_token(cell, key, length)


def blind_order(df: DataFrame, key: bytes, cell: Column, tie: str, in_plan: bool = False) -> DataFrame:
    """df with its blind token and its 1-based position in the order of tokens.

    Positions come from a range-partitioned sort by token and ``tie``: rows are
    counted per range and numbered within it, so no task sorts all, nor all
    rows of one common cell. The ranges are sampled, so they are kept by a
    checkpoint before they are counted.
    """
    rows = df.withColumn("blind_token", token(cell, key, in_plan=in_plan)).repartitionByRange("blind_token", tie)
    rows = cut(rows.withColumn("lead", F.spark_partition_id()))
    sizes = rows.groupBy("lead").agg(F.count("*").alias("n"))
    before = W.partitionBy(F.lit(1)).orderBy("lead").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    offsets = sizes.select("lead", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(W.partitionBy("lead").orderBy("blind_token", tie))
    return rows.join(F.broadcast(offsets), "lead").withColumn("position", own + F.col("offset")).drop("lead", "offset")


def ordering_leak(ordered: DataFrame, attribute: str, position: str = "position") -> DataFrame:
    """One row: n, n_values, n_runs and whether the order gives the attribute away.

    It does if each value forms one run, or if two values alternate strictly.
    A single value can't leak. Rows are numbered from 1 without gaps, so a
    row's predecessor is found by an equi-join in place of a global window.
    """
    a = ordered.select(F.col(position).alias("p"), F.col(attribute).alias("v"))
    b = a.select((F.col("p") + 1).alias("p"), F.col("v").alias("w"), F.lit(1).alias("has"))
    one = a.join(b, "p", "left").agg(
        F.count("*").alias("n"),
        F.count_distinct("v").alias("n_values"),
        F.coalesce(F.count_if(F.col("has").isNotNull() & ~F.col("v").eqNullSafe(F.col("w"))), F.lit(0)).alias("changes"),
    )
    grouped = F.col("changes") + 1 == F.col("n_values")
    alternating = (F.col("n_values") == 2) & (F.col("changes") == F.col("n") - 1)
    return one.select("n", "n_values", (F.col("changes") + 1).alias("n_runs"), ((F.col("n_values") >= 2) & (grouped | alternating)).alias("leaks"))

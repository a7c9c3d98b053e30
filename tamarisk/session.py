"""Session helpers: reading tables, cutting lineage, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows that any operator broadcasts or brings to the driver.
BROADCAST_ROWS = 100_000
#: Rows of one key from which a join splits the key over several tasks.
HOT_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only where that is unset, as in local tests, a temporary folder is set.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tamarisk-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows with the lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows at most ``rows`` rows, else df.

    Without the hint the planner joins by a shuffle, so any size works.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_split(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "inner", hot_rows: int | None = None) -> DataFrame:
    """left joined with right, a key with very many rows on the left split over several tasks.

    ``right`` has few rows for each key. A right side counted to be small is
    broadcast. Else keys with more than ``hot_rows`` rows are counted (with
    partial sums, so no task sees a whole key); there are at most rows /
    hot_rows of them, and that list is broadcast after a count. Their rows on
    the left are spread by the hash of ``spread``, those on the right repeated.
    ``how`` is inner, left, left_semi or left_anti.
    """
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys, how)
    hot_rows = hot_rows or HOT_ROWS
    hot = cut(left.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).withColumn("_parts", F.ceil(F.col("_n") / hot_rows).cast("int")).drop("_n"))
    hot = broadcast_if_small(hot)
    one = F.coalesce(F.col("_parts"), F.lit(1))
    left = left.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(spread), one).cast("int")).drop("_parts")
    right = right.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), one - 1))).drop("_parts")
    return left.join(right, [*keys, "_part"], how).drop("_part")

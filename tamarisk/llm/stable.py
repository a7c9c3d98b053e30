"""Reproducible samples that stay stable as data grows: permanent random numbers.

Each identifier gets a uniform number when it is first seen and keeps it in a
registry; later batches are added by an anti-join insert. The sample of a seed
at a rate holds the identifiers whose number lies on the arc [start(seed),
start(seed) + rate) of the unit circle. The arc of a larger rate contains that
of a smaller one, so a sample under a non-decreasing threshold only gains
members, and neither reruns, partitions nor new rows change earlier choices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tamarisk.session import broadcast_if_small, cut, join_split

#: The circle is cut into this many equal arcs for the join of plans and numbers.
ARCS = 4096
#: Numbers sorted in one bucket on average.
BUCKET_ROWS = 10_000
SCHEMA = "id string, prn double"


def number(c: Column) -> Column:
    """The uniform number of an identifier: 52 bits of its SHA-256."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def start(seed: Column) -> Column:
    """Where the arc of a seed begins, in [0, 1)."""
    return number(F.concat(F.lit("seed:"), seed.cast("string")))


def registered(spark: SparkSession, path: str) -> DataFrame:
    """The registry at ``path`` (id, prn), empty if there is none yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)


def current(ids: DataFrame, registry: DataFrame, column: str) -> DataFrame:
    """The rows of the registry whose identifier ``ids`` has now."""
    now = ids.select(F.col(f"`{column}`").cast("string").alias("id")).where("id IS NOT NULL").distinct()
    return registry.join(now, "id", "left_semi")


def register(ids: DataFrame, path: str, column: str) -> DataFrame:
    """Insert the identifiers not yet in the registry; gives the registry.

    Null identifiers get no number. Repeated rows get one. The insert is an
    append of the anti-join, so a number is never changed once it is written.
    Run one insert on a registry at a time.
    """
    spark = ids.sparkSession
    new = ids.select(F.col(f"`{column}`").cast("string").alias("id")).where("id IS NOT NULL").distinct()
    new = new.join(registered(spark, path), "id", "left_anti").select("id", number(F.col("id")).alias("prn"))
    new.write.mode("append").parquet(path)
    return registered(spark, path)


def _known(plans: DataFrame) -> DataFrame:
    """One row per plan: plan_id, seed (0 for null), rate (at most 1; 0 for null and NaN)."""
    rate = F.least(F.lit(1.0), F.nanvl(F.coalesce(F.col("rate"), F.lit(0.0)), F.lit(0.0)))
    return plans.select("plan_id", F.coalesce(F.col("seed"), F.lit(0)).alias("seed"), rate.alias("rate")).where("plan_id IS NOT NULL").dropDuplicates(["plan_id"])


def arcs(plans: DataFrame) -> DataFrame:
    """The plans' arcs, one row for each of the ARCS pieces that one touches."""
    at = _known(plans).where("rate > 0").withColumn("start", start(F.col("seed")))
    first = F.floor(F.col("start") * ARCS)
    last = F.least(first + ARCS - 1, F.floor((F.col("start") + F.col("rate")) * ARCS))
    return at.withColumn("arc", F.explode(F.sequence(first, last))).withColumn("arc", F.pmod("arc", F.lit(ARCS)))


def members(registry: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, id) of every plan's sample.

    As many rows as the samples have, so meant for the plans asked for; all
    plans together are described by :func:`positions`. An equi-join on the
    piece of the circle, of which the plans' side is broadcast after a count;
    then the exact test. A piece holds 1/ARCS of the numbers, which are
    uniform, so no key is hot.
    """
    numbers = registry.withColumn("arc", F.floor(F.col("prn") * ARCS))
    return numbers.join(broadcast_if_small(arcs(plans)), "arc").where(_inside()).select("plan_id", "id")


def _inside() -> Column:
    gap = F.col("prn") - F.col("start")
    return F.when(gap >= 0, gap).otherwise(gap + 1) < F.col("rate")


def positions(registry: DataFrame, plans: DataFrame, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """All samples at a cost that is linear in identifiers and plans.

    plans: plan_id, seed, rate. Gives the identifiers (id, prn, position in the
    order of the numbers, n_plans that hold it) and the plans (plan_id, first,
    n_chosen): a plan's sample are the n_chosen identifiers from position
    ``first`` on, counted round the circle. All (plan, id) pairs would grow as
    the square of the data where plans grow with it.

    Numbers and the ends of the arcs are sorted together in buckets of about
    ``bucket_rows``; running sums over a bucket and the sums of the buckets
    before it give positions and how many arcs lie over a number. Ends that
    plans of one seed share are one point.

    Null seeds count as 0; null or non-positive rates choose nothing, rates of
    1 or more everything. Repeated plans count once. No plans: n_plans is 0. An
    empty registry gives no identifiers and samples of none.
    """
    total = registry.count()
    buckets = max(1, -(-total // bucket_rows))
    grid = 2.0**52  # numbers, starts and so the tests of membership are multiples of 1 / grid
    known = _known(plans)
    share = F.ceil(F.greatest(F.lit(0.0), F.col("rate")) * grid) / grid
    known = known.withColumn("low", start(F.col("seed"))).withColumn("share", share).withColumn("wraps", F.col("low") + F.col("share") >= 1)
    known = known.withColumn("high", F.when(F.col("wraps"), F.col("low") - 1 + F.col("share")).otherwise(F.col("low") + F.col("share"))).withColumn("all", F.col("rate") >= 1)
    known = cut(known)
    part = known.where("share > 0 AND NOT all")
    base = known.agg(F.count_if(F.col("all") | ((F.col("share") > 0) & F.col("wraps")))).first()[0]
    ends = part.select(F.explode(F.array(F.struct(F.col("low").alias("x"), F.lit(1).alias("d")), F.struct(F.col("high").alias("x"), F.lit(-1).alias("d")))).alias("e"))
    ends = ends.groupBy("e.x").agg(F.sum("e.d").alias("d"))
    points = registry.select(F.col("prn").alias("x"), "id", F.lit(1).alias("one"), F.lit(0).cast("bigint").alias("d"))
    points = points.unionByName(ends.select("x", F.lit(None).cast("string").alias("id"), F.lit(0).alias("one"), "d"))
    points = cut(points.withColumn("bucket", F.floor(F.col("x") * buckets)))
    sums = points.groupBy("bucket").agg(F.sum("one").alias("ones"), F.sum("d").alias("ds"))
    before = W.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # a row for each bucket
    offsets = sums.select("bucket", F.coalesce(F.sum("ones").over(before), F.lit(0)).alias("ones"), F.coalesce(F.sum("ds").over(before), F.lit(0)).alias("ds"))
    own = W.partitionBy("bucket").orderBy("x", "one", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = points.withColumn("k", F.sum("one").over(own)).withColumn("depth", F.sum("d").over(own)).join(broadcast_if_small(offsets), "bucket")
    ranked = ranked.select("x", "id", "one", (F.col("ones") + F.col("k")).alias("k"), (F.col("ds") + F.col("depth") + base).alias("n_plans"))
    numbers = ranked.where("one = 1").select("id", F.col("x").alias("prn"), (F.col("k") - 1).alias("position"), "n_plans")
    ends = cut(ranked.where("one = 0").select("x", "k"))
    found = join_split(known, ends.select(F.col("x").alias("low"), F.col("k").alias("k_low")), ["low"], F.col("plan_id"), "left")
    found = join_split(found, ends.select(F.col("x").alias("high"), F.col("k").alias("k_high")), ["high"], F.col("plan_id"), "left")
    n = F.when(F.col("all"), F.lit(total)).when(F.col("share") > 0, F.col("k_high") - F.col("k_low") + F.when(F.col("wraps"), F.lit(total)).otherwise(0)).otherwise(0)
    first = F.when(F.col("all") | (F.lit(total) == 0), 0).when(F.col("share") > 0, F.col("k_low") % max(1, total))
    return numbers, found.select("plan_id", first.cast("bigint").alias("first"), n.cast("bigint").alias("n_chosen"))

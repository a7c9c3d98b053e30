"""Samples that match target category proportions, with floors and a report.

Systematic unequal-probability sampling. The units of a plan are ordered by
category and at random within it; unit k of a category with N units and
target t has inclusion probability t / N. Their prefix sums, shifted by one
random start per plan, cross an integer exactly where a unit is drawn. Floors
are repaired afterwards with the next units in the same random order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarisk.session import BROADCAST_ROWS, cut

#: White space as Python's str.strip sees it.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"
#: Units of one sort task; groups beyond it are ranked in several buckets.
BUCKET_ROWS = 4_000
_TO_UNIT = 2.0**-53


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns' values alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") * F.lit(_TO_UNIT)


def frame(rows: DataFrame, unit: str, fields: list[str], aliases: DataFrame) -> DataFrame:
    """Distinct (batch_id, field, category, unit_id) of the rows of a table.

    A written value is of the category that ``aliases`` (field, alias,
    category; a small table of names) gives for it, case and outer blanks
    aside. Null and unlisted values, null ids and null batches give no row.
    """
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("v")) for f in fields]))
    long = rows.select("batch_id", F.col(f"`{unit}`").cast("string").alias("unit_id"), values.alias("x"))
    long = long.select("batch_id", "unit_id", "x.field", F.lower(stripped(F.col("x.v"))).alias("alias"))
    long = long.where("batch_id IS NOT NULL AND unit_id IS NOT NULL AND alias IS NOT NULL")
    names = aliases.select("field", F.lower(stripped(F.col("alias"))).alias("alias"), "category").distinct()
    return long.join(names, ["field", "alias"]).select("batch_id", "field", "category", "unit_id").distinct()


def cells(plans: DataFrame, targets: DataFrame, units: DataFrame) -> DataFrame:
    """One row per target: wanted, floor, available, target mass and its prefix."""
    plans = plans.select("plan_id", "batch_id", "field", F.coalesce("seed", F.lit(0)).alias("seed"), F.col("requested").cast("double").alias("requested"))
    plans = plans.where("plan_id IS NOT NULL").dropDuplicates(["plan_id"])
    exact = F.coalesce(F.col("target_share") * F.col("requested"), F.lit(0.0))
    whole = F.round(exact)
    targets = targets.where("category IS NOT NULL").groupBy("plan_id", "category").agg(F.max("target_share").alias("target_share"), F.max("min_rows").alias("min_rows"))
    have = units.groupBy("batch_id", "field", "category").agg(F.count("*").alias("available"))
    out = (
        targets.join(plans, "plan_id")
        .withColumn("target", F.when(F.abs(exact - whole) < 1e-6, whole).otherwise(exact))
        .withColumn("min_rows", F.coalesce("min_rows", F.lit(0)))
        .withColumn("wanted", F.greatest("target", F.col("min_rows").cast("double")))
        .join(have, ["batch_id", "field", "category"], "left")
        .fillna({"available": 0})
        .withColumn("mass", F.least("target", F.col("available").cast("double")))
    )
    before = W.partitionBy("plan_id").orderBy("category").rowsBetween(W.unboundedPreceding, -1)
    out = (
        out.withColumn("before", F.coalesce(F.sum("mass").over(before), F.lit(0.0)))
        .withColumn("start", uniform(F.col("seed"), F.col("plan_id").cast("string"), F.lit("start")))
        .withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("available") / BUCKET_ROWS)).cast("int"))
    )
    # what the crossings give is known beforehand: a fractional target its floor or its ceiling
    chosen = F.floor(F.col("before") + F.col("mass") + F.col("start")) - F.floor(F.col("before") + F.col("start"))
    return out.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("min_rows").cast("bigint"), "available") - chosen))


def draw(units: DataFrame, plan_cells: DataFrame, salts: int = 16) -> DataFrame:
    """The drawn units: plan_id, category, unit_id, repaired (drawn for a floor).

    A unit's place k within its category is its rank in a random order given
    by hash(seed, unit_id): units fall into ordered hash buckets of bounded
    size, and a unit's rank is its rank in the bucket plus the units of all
    buckets before. So no task sorts a whole category or batch. The small side
    (one row per target) is broadcast only if it is counted to be small; else
    the join is salted, as one batch may hold a third of all rows.
    """
    need = ["batch_id", "field", "category"]
    plan_cells = plan_cells.where("available > 0 AND mass + extra > 0").select(*need, "plan_id", "seed", "available", "mass", "before", "start", "extra", "buckets")
    if plan_cells.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rows = units.join(F.broadcast(plan_cells), need)
    else:
        rows = units.withColumn("salt", F.pmod(F.xxhash64("unit_id"), F.lit(salts))).join(
            plan_cells.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*need, "salt"]
        )
    rows = rows.withColumn("r", uniform(F.col("seed"), F.col("unit_id"))).withColumn("bucket", F.floor(F.col("r") * F.col("buckets")).cast("int"))
    group = ["plan_id", "category", "bucket"]
    in_bucket = W.partitionBy(*group).orderBy("r", "unit_id")
    rows = rows.withColumn("k", F.row_number().over(in_bucket))
    earlier = W.partitionBy("plan_id", "category").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.where("buckets > 1").groupBy(*group).agg(F.max("k").alias("n"))
    offsets = offsets.select(*group, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    rows = rows.join(offsets, group, "left").withColumn("k", F.col("k") + F.coalesce("offset", F.lit(0)))
    crossed = lambda k: F.floor(F.col("before") + k * F.col("mass") / F.col("available") + F.col("start"))
    chosen = crossed(F.col("k")) > crossed(F.col("k") - 1)
    unchosen_rank = F.col("k") - (crossed(F.col("k")) - F.floor(F.col("before") + F.col("start")))
    repaired = ~chosen & (unchosen_rank <= F.col("extra"))
    return rows.select("plan_id", "category", "unit_id", repaired.alias("repaired"), chosen.alias("c")).where("c OR repaired").drop("c")


def report(plan_cells: DataFrame, drawn: DataFrame) -> DataFrame:
    """One row per target: wanted, available, drawn and whether it was met.

    It wasn't if fewer than its floor or than the whole part of its target were
    drawn, or if all its units were drawn and are fewer than wanted.
    """
    got = drawn.groupBy("plan_id", "category").agg(F.count("*").alias("drawn"))
    n = F.col("drawn")
    met = (n >= F.floor("target")) & (n >= F.col("min_rows")) & ((n >= F.col("wanted")) | (n < F.col("available")))
    return (
        plan_cells.join(got, ["plan_id", "category"], "left")
        .fillna({"drawn": 0})
        .select("plan_id", "category", "target", F.col("min_rows").cast("int").alias("min_rows"), "available", "drawn", met.alias("met"))
    )


def sample(plans: DataFrame, targets: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Draw every plan's sample; gives the drawn units and the report.

    plans: plan_id, batch_id, field, seed, requested. targets: plan_id,
    category, target_share, min_rows. units: as from :func:`frame`.

    The units are gathered once and checkpointed, as are the targets' cells (a
    row for each target). A fractional target gets the whole number below or
    above it. A category of which fewer units exist than wanted (the larger of
    its target and its floor) gives all it has and is reported as not met; its
    deficit isn't moved to others, which would distort their shares. Floors
    come on top of the targets. An id that has two categories in a batch is a
    unit of both. Nulls: plans without id and targets without category are
    ignored; a null seed counts as 0, null shares, sizes and floors as 0.
    Repeated rows of plans, targets or units count once. Ties in the random
    order are broken by unit_id. Empty tables give empty results.
    """
    units = cut(units)
    plan_cells = cut(cells(plans, targets, units))
    drawn = draw(units, plan_cells)
    return drawn, report(plan_cells, drawn)

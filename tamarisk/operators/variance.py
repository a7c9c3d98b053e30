"""Two-way variance components and cluster-robust standard errors.

Input: ad_id, pair_id, difference, one row per cell; any scale. The source is
scanned once: cells are checked for repeats while they are combined, and one
aggregation over grouping sets gives the sums of ads, of pairs and of all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.session import cut

#: How intervals name their clustering.
CLUSTERING = "two-way clustered by ad and pair"
#: A sum of variances below this share of its terms is rounding error, not positive.
ROUNDING = 1e-12


@dataclass(frozen=True)
class Design:
    """Counts, mean and sum of squared deviations, and the sums by ad and by pair."""

    n: int
    n_ads: int
    n_pairs: int
    mean: float
    ss: float
    margins: DataFrame  # (g, total, n): g is 1 for an ad, 2 for a pair

    @property
    def naive(self) -> float:
        """sd / sqrt(n)."""
        return math.sqrt(self.ss / (self.n - 1) / self.n) if self.n > 1 else 0.0

    def squares(self, of: Column) -> tuple[float, float]:
        """The sums of ``of`` squared over the ads and over the pairs."""
        got = {r[0]: r[1] for r in self.margins.where("g < 3").groupBy("g").agg(F.sum(of * of)).collect()}
        return got[1], got[2]


def design(d: DataFrame) -> Design:
    """The design's sums; repeated cells and nulls are errors.

    Only a row for each ad and pair is kept, not the cells; the sum of squares
    is the central moment that Spark merges without cancellation.
    """
    cells = d.groupBy("ad_id", "pair_id").agg(F.count("*").alias("k"), F.sum(F.col("difference").cast("double")).alias("x"))
    g = F.grouping_id()
    sums = [F.sum("x").alias("total"), F.count("*").alias("n"), F.max("k").alias("most"), (F.var_pop("x") * F.count("*")).alias("ss"), F.avg("x").alias("mean")]
    blank = F.max(F.col("ad_id").isNull() | F.col("pair_id").isNull() | F.col("x").isNull()).alias("blank")
    margins = cut(cells.groupingSets([["ad_id"], ["pair_id"], []], "ad_id", "pair_id").agg(g.alias("g"), blank, *sums))
    rows = margins.groupBy("g").agg(F.count("*").alias("groups"), F.max("n").alias("n"), F.max("most").alias("most"), F.max("ss").alias("ss"), F.max("mean").alias("mean"), F.max("total").alias("total"))
    found = {r.g: r for r in rows.collect()}
    if 3 not in found or not found[3].n:
        raise ValueError("no differences")
    if not margins.where("blank").isEmpty():
        raise ValueError("an id or a difference is null")
    if found[3].most > 1:
        raise ValueError("a cell (ad, pair) occurs twice")
    one = found[3]
    return Design(one.n, found[1].groups, found[2].groups, one.mean, one.ss, margins)


def _row(d: DataFrame, **values: float | int | str) -> DataFrame:
    """One row of literals, as a plan without Python."""
    kind = {float: "double", int: "bigint", str: "string"}
    return d.sparkSession.range(0, 1, 1, 1).select(*[F.lit(v).cast(kind[type(v)]).alias(k) for k, v in values.items()])


def components(d: DataFrame) -> DataFrame:
    """One row: method-of-moments components of a balanced design, clipped at 0."""
    g = design(d)
    if g.n_ads < 2 or g.n_pairs < 2:
        raise ValueError("the design needs two ads and two pairs")
    if g.n != g.n_ads * g.n_pairs:
        raise ValueError("the design isn't balanced: a cell is missing")
    ss_ad, ss_pair = g.squares(F.col("total") / F.col("n") - g.mean)
    rest = g.ss - g.n_pairs * ss_ad - g.n_ads * ss_pair
    resid = (rest if rest > ROUNDING * g.ss else 0.0) / ((g.n_ads - 1) * (g.n_pairs - 1))
    s_ad = max(0.0, (g.n_pairs * ss_ad / (g.n_ads - 1) - resid) / g.n_pairs)
    s_cv = max(0.0, (g.n_ads * ss_pair / (g.n_pairs - 1) - resid) / g.n_ads)
    return _row(d, sigma2_ad=s_ad, sigma2_cv=s_cv, sigma2_resid=resid, n_ads=g.n_ads, n_pairs=g.n_pairs)


def _robust(g: Design) -> tuple[float, bool]:
    """The cluster-robust standard error, and whether it is the two-way estimate."""
    va, vp = g.squares(F.col("total") - F.col("n") * g.mean)
    both = va + vp - g.ss
    two_way = both > ROUNDING * (va + vp + g.ss)
    return math.sqrt(both if two_way else max(va, vp)) / g.n, two_way


def cluster_robust(d: DataFrame) -> DataFrame:
    """One row: mean, se, counts and clustering.

    V = V_ad + V_pair - V_cell, each the sum of squared cluster sums of the
    centred differences over n squared, without small-sample factor; where
    that isn't positive, the larger of V_ad and V_pair, which is said.
    """
    g = design(d)
    se, two_way = _robust(g)
    name = CLUSTERING if two_way else CLUSTERING + ", larger one-way variance (two-way estimate not positive)"
    return _row(d, mean_difference=g.mean, se=se, n=g.n, n_ads=g.n_ads, n_pairs=g.n_pairs, clustering=name)


def naive_se(d: DataFrame) -> DataFrame:
    """One row: sd / sqrt(n) as if cells were independent."""
    return d.agg((F.stddev_samp("difference") / F.sqrt(F.when(F.count("*") >= 2, F.count("*")).otherwise(F.raise_error(F.lit("two differences are needed")).cast("bigint")))).alias("naive_se"))


def inflation(d: DataFrame) -> DataFrame:
    """One row: the cluster-robust over the naive standard error."""
    g = design(d)
    if not g.naive > 0:
        raise ValueError("the naive standard error is 0")
    return _row(d, se_inflation=_robust(g)[0] / g.naive)


def predicted_se(s_ad: Column, s_cv: Column, s_res: Column, n_ads: Column, n_pairs: Column) -> Column:
    ok = (n_ads >= 1) & (n_pairs >= 1)
    se = F.sqrt(s_ad / n_ads + s_cv / n_pairs + s_res / (n_ads * n_pairs))
    return F.when(ok, se).otherwise(F.raise_error(F.lit("counts must be 1 or more")).cast("double"))


def interval(df: DataFrame, z: float = 1.96) -> DataFrame:
    """df with low and high: mean -+ z se."""
    return df.withColumn("low", F.col("mean_difference") - z * F.col("se")).withColumn("high", F.col("mean_difference") + z * F.col("se"))


def predicted_se_value(s_ad: float, s_cv: float, s_res: float, n_ads: int, n_pairs: int) -> float:
    if n_ads < 1 or n_pairs < 1:
        raise ValueError("counts must be 1 or more")
    return math.sqrt(s_ad / n_ads + s_cv / n_pairs + s_res / (n_ads * n_pairs))

"""Holm's correction, equivalence tests, power."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarisk.functions.stats import normal_cdf, normal_quantile, student_t_cdf
from tamarisk.operators.variance import predicted_se


def holm(p_values: DataFrame, alpha: float = 0.05) -> DataFrame:
    """family, label, p_value with p_adjusted and reject, step-down within a family.

    The running maximum of (m - i) p over p sorted upwards, ties by label, at
    most 1. A blank family or a p outside [0, 1] raises when read. A family
    is one group; it is the set of planned tests, so small.
    """
    bad = (F.trim(F.coalesce("family", F.lit(""))) == "") | ~F.coalesce(F.col("p_value").between(0, 1), F.lit(False))
    p = F.when(bad, F.raise_error(F.lit("a family needs a name, a p value must lie in [0, 1]")).cast("double")).otherwise(F.col("p_value"))
    order = W.partitionBy("family").orderBy("p_value", "label")
    m = F.count("*").over(W.partitionBy("family"))
    rows = p_values.withColumn("p_value", p).withColumn("step", (m - F.row_number().over(order) + 1) * F.col("p_value"))
    rows = rows.withColumn("p_adjusted", F.least(F.lit(1.0), F.max("step").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))))
    return rows.select("family", "label", "p_value", "p_adjusted", (F.col("p_adjusted") <= alpha).alias("reject"))


def holm_summary(adjusted: DataFrame) -> DataFrame:
    """A line per family."""
    n = adjusted.groupBy("family").agg(F.count_if("reject").alias("r"), F.count("*").alias("m"))
    return n.select("family", F.format_string("%s: %d of %d tests rejected after Holm's correction", "family", "r", "m").alias("summary"))


def tost(df: DataFrame, margin: str = "margin", alpha: float = 0.05) -> DataFrame:
    """df (difference, se, margin, df) with p_lower, p_upper, p_value and equivalent."""
    ok = (F.col("se") > 0) & (F.col(margin) > 0)
    se = F.when(ok, F.col("se")).otherwise(F.raise_error(F.lit("se and margin must be positive")).cast("double"))
    lower = 1 - student_t_cdf((F.col("difference") + F.col(margin)) / se, F.col("df"))
    upper = student_t_cdf((F.col("difference") - F.col(margin)) / se, F.col("df"))
    out = df.withColumn("p_lower", lower).withColumn("p_upper", upper)
    out = out.withColumn("p_value", F.greatest("p_lower", "p_upper"))
    return out.withColumn("equivalent", F.col("p_value") <= alpha)


def power(margin: float, se: Column, alpha: float = 0.05) -> Column:
    """Two-sided power of a normal test to see ``margin``."""
    z = normal_quantile(1 - alpha / 2)
    shift = F.lit(float(margin)) / se
    return normal_cdf(shift - z) + normal_cdf(-shift - z)


def power_curve(grid: DataFrame, components: tuple[float, float, float], margin: float, n_pairs: int, alpha: float = 0.05) -> DataFrame:
    """n_ads (distinct), se and power; zero components raise, by division."""
    rows = grid.select(F.col("n_ads").cast("bigint").alias("n_ads")).distinct()
    parts = [F.lit(float(c)) for c in components]
    rows = rows.withColumn("se", predicted_se(*parts, F.col("n_ads"), F.lit(n_pairs)))
    return rows.withColumn("power", power(margin, F.col("se"), alpha))


def required_ads(components: tuple[float, float, float], margin: float, n_pairs: int, target: float = 0.8, alpha: float = 0.05, most: int = 100_000) -> int | None:
    """The least number of ads whose power reaches the target, by bisection.

    None if not even infinitely many ads would do, or more than ``most``.
    """
    from statistics import NormalDist

    from tamarisk.operators.variance import predicted_se_value

    cdf, z = NormalDist().cdf, normal_quantile(1 - alpha / 2)
    at = lambda se: cdf(margin / se - z) + cdf(-margin / se - z)
    s_ad, s_cv, s_res = components
    floor = (s_cv / n_pairs) ** 0.5
    if floor > 0 and at(floor) < target or at(predicted_se_value(*components, most, n_pairs)) < target:
        return None
    low, high = 1, most
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if at(predicted_se_value(*components, mid, n_pairs)) >= target else (mid + 1, high)
    return low

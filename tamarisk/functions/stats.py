"""Distribution functions as expressions, from built-ins."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function, to 2e-16 on [-8, 8].

    1/2 + phi(x) * sum of x^(2k+1) / (2k+1)!!, each term from the one before.
    """
    first = F.struct(x.cast("double").alias("term"), x.cast("double").alias("total"))

    def step(state: Column, k: Column) -> Column:
        term = state["term"] * x * x / (2 * k + 1)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(200)), first, step, lambda s: s["total"])
    inside = 0.5 + F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * series
    return F.when(x > 8, 1.0).when(x < -8, 0.0).otherwise(inside)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def student_t_cdf(t: Column, df: Column) -> Column:
    """Student's t with an integer number of degrees of freedom.

    The finite trigonometric series in theta = atan(t / sqrt(df)): for odd df
    over cos^1, cos^3, ..., for even df over cos^0, cos^2, ...
    """
    df = df.cast("int")
    theta = F.atan(t / F.sqrt(df.cast("double")))
    cos2 = F.cos(theta) * F.cos(theta)
    odd = df % 2 == 1
    terms = F.when(odd, F.floor((df - 1) / 2)).otherwise(F.floor(df / 2)).cast("int")
    first = F.when(odd, F.cos(theta)).otherwise(F.lit(1.0))
    state = F.struct(first.alias("term"), F.lit(0.0).alias("total"))

    def step(s: Column, k: Column) -> Column:
        ratio = F.when(odd, (2 * k) / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        return F.struct((s["term"] * ratio * cos2).alias("term"), (s["total"] + s["term"]).alias("total"))

    range_ = F.when(terms > 0, F.sequence(F.lit(1), F.greatest(terms, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(range_, state, step, lambda s: s["total"])
    within = F.when(odd, 2 / math.pi * (theta + F.sin(theta) * total)).otherwise(F.sin(theta) * total)
    return 0.5 + within / 2


def uniform(c: Column) -> Column:
    """A number in (0, 1] from the SHA-256 of a string; the same wherever it is computed."""
    return (F.conv(F.substring(F.sha2(c, 256), 1, 13), 16, 10).cast("double") + 1) / F.lit(2.0**52)


def normal(c: Column) -> Column:
    """A standard normal number from a string (Box and Muller), unlike randn free of partitions."""
    u, v = uniform(F.concat(c, F.lit("|u"))), uniform(F.concat(c, F.lit("|v")))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)

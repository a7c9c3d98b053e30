"""Synthetic paired scores with known truth."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.functions.stats import normal
from tamarisk.session import BROADCAST_ROWS


class Backend(Protocol):
    """Anything that scores all (ad, pair) combinations."""

    def score_pairs(self, ads: DataFrame, pairs: DataFrame) -> DataFrame: ...


def difference() -> Column:
    """score_f - score_m, always computed, never stored beside them."""
    return F.col("score_f") - F.col("score_m")


@dataclass(frozen=True)
class Synthetic:
    """A linear score model; every sd must be non-negative."""

    effect: float = 0.0
    sd_ad: float = 0.0
    sd_pair: float = 0.0
    sd_ad_gender: float = 0.0
    sd_pair_gender: float = 0.0
    sd_resid: float = 1.0
    mu: float = 0.0
    seed: int = 0

    def __post_init__(self) -> None:
        for f in fields(self):
            if f.name.startswith("sd_") and getattr(self, f.name) < 0:
                raise ValueError(f"{f.name} must not be negative")

    def score_pairs(self, ads: DataFrame, pairs: DataFrame) -> DataFrame:
        """(ad_id, pair_id, score_f, score_m, difference) of every combination.

        The combinations are the design itself: all ads with all pairs. An
        empty side raises. The pairs are broadcast after a count; more of them
        meet the ads in blocks, by an equi-join on the block.
        Numbers come from hashes of seed, stream and id, so they are the same
        in any partitioning. Repeated and null ids count once and not at all.
        """
        a = ads.select(F.col(ads.columns[0]).cast("string").alias("ad_id")).where("ad_id IS NOT NULL").distinct()
        b = pairs.select(F.col(pairs.columns[0]).cast("string").alias("pair_id")).where("pair_id IS NOT NULL").distinct()
        z = lambda stream, *ids: normal(F.concat_ws("|", F.lit(str(self.seed)), F.lit(stream), *ids))
        ad, pair = F.col("ad_id"), F.col("pair_id")
        n = b.limit(BROADCAST_ROWS + 1).count()
        if not n or a.isEmpty():
            raise ValueError("an empty design: it needs an ad and a pair")
        if n <= BROADCAST_ROWS:
            rows = a.join(F.broadcast(b))
        else:
            blocks = 200
            split = b.withColumn("block", F.pmod(F.xxhash64("pair_id"), F.lit(blocks)))
            rows = a.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("bigint")).join(split, "block").drop("block")
        level = self.mu + self.sd_ad * z("ad", ad) + self.sd_pair * z("pair", pair)
        half = (self.effect + self.sd_ad_gender * z("ad_gender", ad) + self.sd_pair_gender * z("pair_gender", pair)) / 2
        rows = rows.select(ad, pair, (level + half + self.sd_resid * z("f", ad, pair)).alias("score_f"), (level - half + self.sd_resid * z("m", ad, pair)).alias("score_m"))
        return rows.withColumn("difference", difference())

"""Which preceding noun an adjective agrees with, as one window pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Heads an adjective can modify, and what it may look past.
NOMINAL_POS = ("noun", "noun_prop", "noun_quant")
SKIPPABLE_POS = ("conj", "adj", "punc")


def agreement_targets(tokens: DataFrame, sentence: str = "sentence_id", strict: bool = False) -> DataFrame:
    """One row per adjective: target_index, competitor_index, outcome, abstain_reason.

    tokens: sentence, index, pos, gen. Looking back over conjunctions,
    adjectives and punctuation, the first other token decides: a nominal of
    the same gender is the target, unless the token right before it is one
    too (two compete); a nominal of another gender disagrees; anything else
    blocks. That token is the last non-skippable one before the adjective, so
    one sorted pass over each sentence finds it. A sentence is one group of
    the window; it is bounded by the text.

    With ``strict``, a row marked as ``is_cue`` that is a verb or no adjective
    raises, when it is read.
    """
    order = W.partitionBy(sentence).orderBy("index")
    nominal = F.coalesce(F.col("pos").isin(*NOMINAL_POS), F.lit(False))
    skippable = F.coalesce(F.col("pos").isin(*SKIPPABLE_POS), F.lit(False))
    rows = tokens.withColumn("position", F.row_number().over(order) - 1)
    rows = rows.withColumn("nominal", nominal)
    before = F.struct("index", "nominal", "gen", F.lag("index").over(order).alias("prev_index"), F.lag("nominal").over(order).alias("prev_nominal"), F.lag("gen").over(order).alias("prev_gen"))
    rows = rows.withColumn("stop", F.when(~skippable, before))
    rows = rows.withColumn("head", F.last("stop", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    adjective = F.col("pos").isin("adj", "adj_comp")
    if strict:
        wrong = F.coalesce(F.col("is_cue"), F.lit(False)) & ~F.coalesce(adjective, F.lit(False))
        rows = rows.where(F.when(wrong, F.raise_error(F.concat(F.lit("no adjective cue: "), F.coalesce("pos", F.lit("null")))).cast("boolean")).otherwise(True))
    agrees = F.coalesce((F.col("head.gen") == F.col("gen")) & F.col("gen").isin("m", "f"), F.lit(False))
    competes = F.coalesce(F.col("head.prev_nominal") & (F.col("head.prev_gen") == F.col("gen")), F.lit(False))
    outcome = (
        F.when(F.col("position") == 0, "initial")
        .when(F.col("head").isNull(), "none")
        .when(~F.col("head.nominal"), "blocked")
        .when(~agrees, "disagrees")
        .when(competes, "two_compete")
        .otherwise("target")
    )
    rows = rows.where(adjective).withColumn("outcome", outcome)
    return rows.select(
        sentence,
        "index",
        "outcome",
        F.when(F.col("outcome") == "target", F.col("head.index")).alias("target_index"),
        F.when(F.col("outcome") == "two_compete", F.col("head.prev_index")).alias("competitor_index"),
        F.when(F.col("outcome") != "target", "AB2").alias("abstain_reason"),
    )

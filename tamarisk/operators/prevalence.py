"""Specified analyses: prevalence, accuracy against gold, selection, pools, registers, twins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarisk.functions.text import BLANK, word_count
from tamarisk.session import broadcast_if_small, cut

#: Pairs of a task of the pool join, and the tasks from which they become more instead.
TASK_PAIRS, MOST_TASKS = 1_000_000, 20_000


def prevalence(docs: DataFrame, cues: DataFrame, by: tuple[str, ...] = ("country", "seniority")) -> DataFrame:
    """(dimension, value): documents, those with an applicant cue, cues per document and per 100 words, abstentions.

    Cues are counted per document before the join, so a document with many
    cues is one row; documents without cues count.
    """
    each = cues.groupBy("doc_id").agg(F.count("*").alias("cues"), F.count_if(F.col("referent") == "applicant").alias("applicant"), F.count_if(F.col("referent") == "ABSTAIN").alias("abstained"))
    rows = docs.select("doc_id", *by, word_count(F.col("text_norm")).alias("words")).join(each, "doc_id", "left").fillna(0, ["cues", "applicant", "abstained"])
    rows = rows.withColumn("d", F.explode(F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), *[F.struct(F.lit(b).alias("dimension"), F.col(b).alias("value")) for b in by])))
    out = rows.groupBy("d.dimension", "d.value").agg(
        F.count("*").alias("n_docs"),
        F.count_if(F.col("applicant") > 0).alias("n_with_applicant"),
        F.sum("cues").alias("n_cues"),
        F.sum("abstained").alias("n_abstained"),
        F.sum("words").alias("n_words"),
    )
    out = out.withColumn("share_with_applicant", F.col("n_with_applicant") / F.col("n_docs")).withColumn("cues_per_doc", F.col("n_cues") / F.col("n_docs"))
    return out.withColumn("cues_per_100_words", F.when(F.col("n_words") > 0, 100 * F.col("n_cues") / F.col("n_words")))


def distribution(cues: DataFrame, by: tuple[str, ...] = ("pos", "tier")) -> DataFrame:
    """(dimension, value, referent): cues and their share of the value's; abstentions are a referent of their own.

    One scan: counts by all of ``by`` and the referent first, then by each of
    them. A null value or referent is (none).
    """
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    counts = cues.groupBy(*[cell(b).alias(b) for b in by], cell("referent").alias("referent")).agg(F.count("*").alias("n"))
    each = counts.select(F.explode(F.array(*[F.struct(F.lit(b).alias("dimension"), F.col(b).alias("value")) for b in by])).alias("d"), "referent", "n")
    sums = each.groupBy("d.dimension", "d.value", "referent").agg(F.sum("n").alias("n_cues"))
    return sums.withColumn("share", F.col("n_cues") / F.sum("n_cues").over(W.partitionBy("dimension", "value")))


def accuracy(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1 and abstention rate by tier and morph_class, and of all together.

    rows: tier, morph_class, predicted, gold; abstentions are predictions
    of their own. Null tier and class of a row show as '(none)', subtotals as '(all)'.
    """
    cell = lambda c: F.coalesce(F.col(c), F.lit("(none)")).alias(c)
    cube = rows.select(cell("tier"), cell("morph_class"), "predicted", "gold").cube("tier", "morph_class").agg(
        F.count("*").alias("n"),
        F.count_if((F.col("predicted") == "applicant") & (F.col("gold") == "applicant")).alias("tp"),
        F.count_if((F.col("predicted") == "applicant") & (F.col("gold") != "applicant")).alias("fp"),
        F.count_if((F.col("predicted") != "applicant") & (F.col("gold") == "applicant")).alias("fn"),
        F.avg((F.col("predicted") == "ABSTAIN").cast("double")).alias("abstention_rate"),
    )
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    f1 = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return cube.select(F.coalesce("tier", F.lit("(all)")).alias("tier"), F.coalesce("morph_class", F.lit("(all)")).alias("morph_class"), "n", p.alias("precision"), r.alias("recall"), f1.alias("f1"), "abstention_rate")


def selection_rates(scores: DataFrame, k: int) -> DataFrame:
    """Per group: rate of being among a pool's top k, and its ratio to the best group's.

    scores: pool_id, group, score, id. Ties in score are broken by id.
    """
    rank = F.row_number().over(W.partitionBy("pool_id").orderBy(F.desc("score"), "id"))
    each = scores.withColumn("chosen", (rank <= k).cast("int")).groupBy("group").agg(F.count("*").alias("n"), F.sum("chosen").alias("n_chosen"))
    each = each.withColumn("selection_rate", F.col("n_chosen") / F.col("n"))
    best = F.max("selection_rate").over(W.partitionBy(F.lit(1)))
    ratio = F.try_divide(F.col("selection_rate"), best)
    return each.withColumn("impact_ratio", ratio).withColumn("below_four_fifths", ratio < 0.8)


def cell_variance(scores: DataFrame, cell: list[str]) -> DataFrame:
    """n, mean and sample variance of the score of each cell."""
    return scores.groupBy(*cell).agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.var_samp("score").alias("variance"))


def inherited(cues: DataFrame, targets: DataFrame, classified: DataFrame) -> DataFrame:
    """Adjective cues with the referent of their target; AB3 where the target abstains itself.

    targets: cue_id and target_id; classified: target_id and referent.
    """
    rows = cues.join(targets, "cue_id", "left").join(classified.select("target_id", F.col("referent").alias("head_referent")), "target_id", "left")
    reason = F.when(F.col("target_id").isNull(), "AB2").when(F.coalesce("head_referent", F.lit("ABSTAIN")) == "ABSTAIN", "AB3")
    return rows.select("cue_id", "target_id", F.when(reason.isNull(), F.col("head_referent")).otherwise("ABSTAIN").alias("referent"), reason.alias("abstain_reason"))


def rank_displacement(scores: DataFrame) -> DataFrame:
    """Per group: how far the twins of a pair are apart in the ranks of their pool.

    scores: pool_id, pair_id, side (f, m), group, score. Ranks count from 1 at
    the highest score, ties by pair and side. One row per group with the
    number of pairs, the mean and the quartiles of rank f minus rank m.
    """
    rank = F.row_number().over(W.partitionBy("pool_id").orderBy(F.desc("score"), "pair_id", "side"))
    sides = scores.withColumn("r", rank).groupBy("pool_id", "pair_id", "group").agg(*[F.max(F.when(F.col("side") == s, F.col("r"))).alias(s) for s in ("f", "m")])
    d = sides.where("f IS NOT NULL AND m IS NOT NULL").withColumn("d", F.col("f") - F.col("m"))
    return d.groupBy("group").agg(F.count("*").alias("n_pairs"), F.avg("d").alias("mean"), *[F.percentile("d", F.lit(q)).alias(n) for q, n in ((0.25, "lower"), (0.5, "median"), (0.75, "upper"))])


def _cell(sd: Column, width: float) -> Column:
    """The cell of an sd, never falling as the sd rises; all beyond 2^40 cells from 0 are in the last one."""
    return F.floor(F.greatest(F.least(sd / width, F.lit(2.0**40)), F.lit(-(2.0**40))))


def matched_pools(targets: DataFrame, candidates: DataFrame, tolerance: float, size: int, seed: int, spare: int = 20) -> DataFrame:
    """(target_id, candidate_id, place): the pool of each target, drawn once for a seed.

    targets: target_id, sd; candidates: candidate_id, sd. A candidate matches
    within ``tolerance``. Of the matches the ``size`` first by SHA-256 of seed,
    target and candidate are taken; a pair with a null id comes last. Null,
    NaN and infinite sds match nothing.

    The range join is an equi-join of cells an eighth as wide as the
    tolerance. Its inputs are small and its output isn't, so the number of
    tasks follows the pairs of each cell, and a cell of many is split. The
    matches of each target are counted, then hashed; sorted are only those
    below the hash under which 2 * size + ``spare`` of them are expected. They
    are the first ones, so a target with ``size`` of them is done. Targets
    with fewer, which chance all but rules out, sort all of their matches.
    """
    if tolerance <= 0 or size < 1:
        raise ValueError("tolerance and size must be positive")
    width, reach, text = tolerance / 8, tolerance * (1 + 2.0**-10), lambda c: F.col(c).cast("string")
    finite = F.abs("sd") < float("inf")
    t = targets.where(finite).select("target_id", F.col("sd").alias("t_sd"), F.concat(F.lit(f"{seed}|"), text("target_id"), F.lit("|")).alias("t_text"))
    c = candidates.where(finite).select("candidate_id", F.col("sd").alias("c_sd"), text("candidate_id").alias("c_text"), _cell(F.col("sd"), width).alias("cell"))
    cells = F.explode(F.sequence(_cell(F.col("t_sd") - reach, width), _cell(F.col("t_sd") + reach, width))).alias("cell")
    near = F.abs(F.col("t_sd") - F.col("c_sd")) <= tolerance
    digest = F.coalesce(F.sha2(F.concat("t_text", "c_text"), 256), F.lit("g"))  # g follows all hex digits

    load = cut(t.select(cells).groupBy("cell").agg(F.count("*").alias("n_t")).join(c.groupBy("cell").agg(F.count("*").alias("n_c")), "cell").select("cell", (F.col("n_t").cast("double") * F.col("n_c")).alias("pairs")))
    total = load.agg(F.sum("pairs")).first()[0] or 0.0
    each = max(TASK_PAIRS, total / MOST_TASKS)
    tasks = max(1, math.ceil(total / each))
    hot = broadcast_if_small(load.where(F.col("pairs") > each).select("cell", F.ceil(F.col("pairs") / each).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    spread = c.join(hot, "cell", "left").withColumn("part", F.pmod(F.xxhash64("candidate_id", "c_sd"), parts).cast("int")).drop("parts").repartition(tasks, "cell", "part")

    def pairs(rows: DataFrame) -> DataFrame:
        rows = rows.select("*", cells).join(hot, "cell", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        return rows.repartition(tasks, "cell", "part").join(spread, ["cell", "part"]).where(near)

    def first(rows: DataFrame) -> DataFrame:
        """The digest is made anew, which is less than to shuffle it."""
        rows = rows.select("target_id", "t_text", "candidate_id", "c_text").repartition("target_id").withColumn("h", digest)
        place = F.row_number().over(W.partitionBy("target_id").orderBy("h", F.asc_nulls_last("candidate_id")))
        return rows.withColumn("place", place).where(F.col("place") <= size).select("target_id", "candidate_id", "place")

    n = cut(pairs(t).groupBy("target_id").agg(F.count("*").alias("n")))
    # Twelve hex digits of the share of digests that is expected to hold enough.
    share = (2 * size + spare) / F.col("n")
    below = n.select(F.col("target_id").alias("id"), F.when(share < 1, F.lower(F.lpad(F.hex((share * 2.0**48).cast("bigint")), 12, "0"))).otherwise("h").alias("below"))
    drawn = cut(first(pairs(t.join(below, F.col("target_id").eqNullSafe(F.col("id"))).drop("id")).where(digest < F.col("below"))))
    got = drawn.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("got"))
    short = cut(n.join(got, F.col("target_id").eqNullSafe(F.col("id")), "left").where(F.coalesce("got", F.lit(0)) < F.least(F.lit(size), F.col("n"))).select(F.col("target_id").alias("id")))
    if short.isEmpty():
        return drawn
    one = F.col("target_id").eqNullSafe(F.col("id"))
    return drawn.join(short, one, "left_anti").unionByName(first(pairs(t.join(short, one, "left_semi"))))


def register_violations(docs: DataFrame, cues: DataFrame) -> DataFrame:
    """(doc_id, register) of documents that break their register's invariant.

    docs: doc_id, register, and for R4 also set_id and text_norm. R1 needs a
    masculine cue that refers to the applicant, R2 applicant cues of both
    genders, R3 none; R5 no cue at all. R4, the placebo, needs masculine
    applicant cues, no feminine ones, and as many words as the R2 of its set
    (with an R2 of several lengths, as one of them); a set without R2 breaks it.
    """
    about = F.col("referent") == "applicant"
    n = cues.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(about & (F.col("gen") == "m")).alias("m"), F.count_if(about & (F.col("gen") == "f")).alias("f"), F.count_if(about).alias("a"))
    placebo = F.lit(True)
    if {"set_id", "text_norm"} <= set(docs.columns):
        sized = docs.select("doc_id", "register", "set_id", word_count(F.col("text_norm")).alias("words"))
        lengths = sized.where("register = 'R2'").groupBy("set_id").agg(F.collect_set("words").alias("lengths"))
        sized = sized.join(lengths, "set_id", "left").groupBy("doc_id", "register").agg(F.bool_and(F.coalesce(F.array_contains("lengths", F.col("words")), F.lit(False))).alias("matched"))
        placebo = F.col("matched")
    else:
        sized = docs.select("doc_id", "register").distinct()
    rows = sized.join(n, "doc_id", "left").fillna(0, ["n", "m", "f", "a"])
    broken = (
        F.when(F.col("register") == "R1", F.col("m") == 0)
        .when(F.col("register") == "R2", (F.col("m") == 0) | (F.col("f") == 0))
        .when(F.col("register") == "R3", F.col("a") > 0)
        .when(F.col("register") == "R4", (F.col("m") == 0) | (F.col("f") > 0) | ~placebo)
        .when(F.col("register") == "R5", F.col("n") > 0)
        .otherwise(False)
    )
    return rows.where(broken).select("doc_id", "register")


def twin_differences(pairs: DataFrame, tolerance: int) -> DataFrame:
    """pair_id with same_word_count, length_delta, within_tolerance, only_f and only_m.

    pairs: pair_id, text_f, text_m. only_f and only_m are the sorted words of
    one side alone: in a valid pair they are the gendered forms.
    """
    words = lambda c: F.filter(F.split(F.regexp_replace(c, f"{BLANK}+", " "), " "), lambda w: w != "")
    f, m = words(F.col("text_f")), words(F.col("text_m"))
    delta = F.length("text_f") - F.length("text_m")
    return pairs.select(
        "pair_id", (F.size(f) == F.size(m)).alias("same_word_count"), delta.alias("length_delta"), (F.abs(delta) <= tolerance).alias("within_tolerance"),
        F.array_sort(F.array_except(f, m)).alias("only_f"), F.array_sort(F.array_except(m, f)).alias("only_m"),
    )

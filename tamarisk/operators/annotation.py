"""The annotation log: answers, agreement, gates, adjudication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.functions.text import BLANK, strip

#: The labels, and the least kappa of a usable gold set.
LABELS = ("applicant", "non_applicant", "unclear")
KAPPA_FLOOR = 0.7
#: The fields of an item an annotator may see, and those never.
ITEM_FIELDS = ("item_id", "sentence", "cue_start", "cue_end", "doc_type")


class GoldSetUnusable(Exception):
    """Agreement is undefined or below the floor."""


def canonical_answer(answer: Column) -> Column:
    """The label an answer spells, whatever its case, outer blanks and word mark; else null."""
    said = F.regexp_replace(F.lower(strip(answer)), rf"(?:{BLANK}|[-_])+", "_")
    return F.when(said.isin(*LABELS), said)


def answers(responses: DataFrame, strict: bool = True) -> DataFrame:
    """Valid rows (seq, item_id, annotator_id, answer).

    An answer outside the labels raises when the rows are read, so that no
    agreement is computed on fewer answers without a word; only where
    ``strict`` is turned off are such rows left out.
    """
    label = canonical_answer(F.col("answer"))
    if strict:
        bad = F.concat(F.lit("no label: "), F.coalesce("answer", F.lit("null")))
        label = F.coalesce(label, F.raise_error(bad).cast("string"))
    rows = responses.select("seq", "item_id", "annotator_id", label.alias("answer"))
    return rows.where("answer IS NOT NULL AND item_id IS NOT NULL AND annotator_id <> ''")


def last_answers(rows: DataFrame) -> DataFrame:
    """Each annotator's last answer to each item, by seq; combined before the shuffle."""
    return rows.groupBy("annotator_id", "item_id").agg(F.max(F.struct("seq", "answer")).alias("v")).select("annotator_id", "item_id", "v.answer", "v.seq")


def by_annotator(rows: DataFrame) -> DataFrame:
    """n_answers, n_items, first and last seq of each annotator.

    A summary in place of lists of answers: one annotator may have given a
    third of them.
    """
    return rows.groupBy("annotator_id").agg(F.count("*").alias("n_answers"), F.count_distinct("item_id").alias("n_items"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def double_annotated(rows: DataFrame) -> DataFrame:
    """Items that at least two annotators answered."""
    pairs = rows.select("item_id", "annotator_id").distinct()
    return pairs.groupBy("item_id").agg(F.count("*").alias("n_annotators")).where("n_annotators >= 2")


def unclear_rate(rows: DataFrame) -> DataFrame:
    """One row: the share of unclear answers, 0 without answers."""
    return rows.agg(F.coalesce(F.avg((F.col("answer") == "unclear").cast("double")), F.lit(0.0)).alias("unclear_rate"))


def todo(items: DataFrame, rows: DataFrame, annotator: str) -> DataFrame:
    """The items the annotator hasn't answered."""
    done = rows.where(F.col("annotator_id") == annotator).select("item_id").distinct()
    return items.join(done, "item_id", "left_anti")


def kappa_pairs(rows: DataFrame) -> DataFrame:
    """Cohen's kappa of all pairs of annotators with items in common.

    (annotator_a, annotator_b, n_items, po, pe, kappa, unclear_rate,
    undefined_reason); kappa is null where chance agreement is complete. The
    self-join is on the item, whose rows are at most one per annotator (agreement
    is defined over pairs, so an item of n annotators has n (n - 1) / 2 of
    them); then one aggregation with conditional counts.
    """
    last = last_answers(rows).select("item_id", "annotator_id", "answer")
    a = last.select("item_id", F.col("annotator_id").alias("annotator_a"), F.col("answer").alias("x"))
    b = last.select("item_id", F.col("annotator_id").alias("annotator_b"), F.col("answer").alias("y"))
    both = a.join(b, "item_id").where("annotator_a < annotator_b")
    sums = [F.count_if(F.col(c) == v).alias(f"{c}_{v}") for c in "xy" for v in LABELS]
    n = both.groupBy("annotator_a", "annotator_b").agg(F.count("*").alias("n_items"), F.count_if(F.col("x") == F.col("y")).alias("same"), *sums)
    count = F.col("n_items").cast("double")
    pe = sum((F.col(f"x_{v}") * F.col(f"y_{v}") for v in LABELS), F.lit(0)) / (count * count)
    n = n.withColumn("po", F.col("same") / count).withColumn("pe", pe)
    n = n.withColumn("kappa", F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / F.nullif(1 - F.col("pe"), F.lit(0.0))))
    return n.select(
        "annotator_a", "annotator_b", "n_items", "po", "pe", "kappa",
        ((F.col("x_unclear") + F.col("y_unclear")) / (2 * count)).alias("unclear_rate"),
        F.when(F.col("kappa").isNull(), "chance agreement is 1").alias("undefined_reason"),
    )


def gate_status(kappas: DataFrame, floor: float = KAPPA_FLOOR) -> DataFrame:
    status = F.when(F.col("kappa").isNull(), "undefined").when(F.col("kappa") < floor, "below_floor").otherwise("usable")
    return kappas.withColumn("gate_status", status)


def assert_usable(kappas: DataFrame, floor: float = KAPPA_FLOOR) -> None:
    """Raise unless every pair's kappa is defined and reaches the floor."""
    bad = gate_status(kappas, floor).where("gate_status <> 'usable'").select("annotator_a", "annotator_b", "kappa", "gate_status").limit(5).collect()
    if bad:
        raise GoldSetUnusable(f"kappa floor {floor}: {bad}")


def adjudicate(a: Column, b: Column, third: Column) -> Column:
    """The label of two answers; on disagreement the third decides or it is unclear."""
    need = F.raise_error(F.lit("a disagreement needs a third answer")).cast("string")
    return F.when(a == b, a).when(third.isNull(), need).when((third == a) | (third == b), third).otherwise("unclear")


def adjudicated(rows: DataFrame) -> DataFrame:
    """Items with an answer of the first two annotators (by id), and a third where they disagree."""
    last = last_answers(rows)
    people = last.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("annotator_id", "answer"))).alias("p")).where("size(p) >= 2")
    get = lambda k: F.get("p", F.lit(k))["answer"]
    open_ = (get(0) != get(1)) & get(2).isNull()
    return people.where(~open_).select("item_id", adjudicate(get(0), get(1), get(2)).alias("answer"))


def blind_items(cues: DataFrame, docs: DataFrame, item_id: Column) -> DataFrame:
    """What an annotator sees of a cue: five fields, under an opaque id given by the caller.

    The document's type is a required lookup. Offsets are taken as they are;
    they suit the sentence only where the sentence is the document.
    """
    types = docs.select("doc_id", "doc_type").dropDuplicates(["doc_id"])
    return cues.join(types, "doc_id").select(item_id.alias("item_id"), F.col("sentence_context").alias("sentence"), F.col("char_start").alias("cue_start"), F.col("char_end").alias("cue_end"), "doc_type")


def sampling_manifest(cues: DataFrame, item_id: Column) -> DataFrame:
    """(item_id, cue_id) of every cue: the restricted table that leads back from what annotators see.

    It is apart from the items on purpose, and its writer must keep it from
    annotators. An item id that two cues share raises when it is read.
    """
    rows = cues.select(item_id.alias("item_id"), "cue_id").distinct()
    one = rows.groupBy("item_id").agg(F.min("cue_id").alias("cue_id"), F.max("cue_id").alias("last"))
    shared = F.raise_error(F.concat(F.lit("two cues share the item id "), "item_id")).cast("string")
    return one.select("item_id", F.when(F.col("cue_id") == F.col("last"), F.col("cue_id")).otherwise(shared).alias("cue_id"))


def unblinded(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """rows (with item_id) with the cue_id of their item; items the manifest doesn't name keep null."""
    return rows.join(manifest, "item_id", "left")


def assert_item_schema(items: DataFrame) -> None:
    """Raise unless the items have exactly the fields that may be shown."""
    if tuple(items.columns) != ITEM_FIELDS:
        raise ValueError(f"items must have exactly {ITEM_FIELDS}, got {tuple(items.columns)}")

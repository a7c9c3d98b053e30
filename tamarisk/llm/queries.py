"""Queries pN_... over the test tables, and the SQL they are checked against."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.llm import abuse, bpe, consensus, formatdup, packing, proportional, sentences, stable
from tamarisk.session import cut, shared_dir, table


def _p1(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    aliases = table(spark, d, "category_aliases")
    docs = proportional.frame(table(spark, d, "doc_records"), "doc_id", ["country", "seniority"], aliases)
    cues = proportional.frame(table(spark, d, "tagged_cues"), "cue_id", ["pos"], aliases)
    return proportional.sample(table(spark, d, "sampling_plans"), table(spark, d, "plan_targets"), docs.unionByName(cues))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d)[1].where("NOT met").select("plan_id", "category")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d)[1].withColumn("target", F.round("target", 6))


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d)[0]


def p1_drawn(spark: SparkSession, d: str) -> DataFrame:
    """The sample counted: units drawn, all different, of the plan's batch and category."""
    plans = table(spark, d, "sampling_plans").select("plan_id", "batch_id", "field")
    drawn = p1_sample(spark, d).join(plans, "plan_id")
    return drawn.groupBy("plan_id", "category").agg(F.count("*").alias("n_drawn"), F.count_distinct("unit_id").alias("n_units"))


def _p2(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return consensus.estimate(table(spark, d, "annotation_responses"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d)[0].where("n_annotators >= 3").select("item_id", "answer")


def p2_items(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d)[0]


def p2_annotators(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d)[1]


def p2_votes(spark: SparkSession, d: str) -> DataFrame:
    """The answers that count: one row per item and annotator."""
    labels = F.array(*map(F.lit, consensus.LABELS))
    return consensus.votes(table(spark, d, "annotation_responses")).select("item_id", "annotator_id", F.element_at(labels, F.col("label") + 1).alias("answer"))


def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Items and answers by the number of annotators, from the consensus itself."""
    return _p2(spark, d)[0].groupBy("n_annotators").agg(F.count("*").alias("n_items"), F.count("answer").alias("n_labelled"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    docs, cues = table(spark, d, "doc_records"), table(spark, d, "tagged_cues")
    texts = docs.select(F.lit("doc").alias("kind"), F.col("doc_id").alias("record_id"), F.col("text_norm").alias("text"))
    return texts.unionByName(cues.select(F.lit("cue").alias("kind"), F.col("cue_id").alias("record_id"), F.col("sentence_context").alias("text")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of records and cue contexts. The statistics are those of all records, of which the contexts are parts."""
    model = sentences.learn(table(spark, d, "doc_records").select(F.col("text_norm").alias("text")))
    return sentences.sentences(_texts(spark, d), ["kind", "record_id"], "text", model)


def p3_letters(spark: SparkSession, d: str) -> DataFrame:
    """Texts and their letters and digits, and how many of these stand in sentences: all, each once."""
    texts = _texts(spark, d).where("text IS NOT NULL").distinct()
    units = p3_found(spark, d).join(texts, ["kind", "record_id"])
    bare = lambda c: F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    inside = units.select("kind", bare(F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))).alias("n"))
    all_ = texts.groupBy("kind").agg(F.count("*").alias("n_texts"), F.sum(bare(F.col("text"))).alias("n_letters"))
    return all_.join(inside.groupBy("kind").agg(F.sum("n").alias("n_inside")), "kind")


def _registry(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of the table's cues, from a registry kept for this folder.

    Cues come in two batches, by when they were tagged, so the second (and
    every later run) meets the numbers given before.
    """
    cues = table(spark, d, "tagged_cues")
    path = f"{shared_dir(spark)}/prn-registry-{hashlib.sha256(os.path.abspath(d).encode()).hexdigest()[:16]}"
    first, last = cues.agg(F.min(F.unix_micros(F.col("tagged_at").cast("timestamp"))), F.max(F.unix_micros(F.col("tagged_at").cast("timestamp")))).first()
    late = F.coalesce(F.unix_micros(F.col("tagged_at").cast("timestamp")) > ((first or 0) + (last or 0)) // 2, F.lit(False))
    stable.register(cues.where(~late), path, "cue_id")
    return stable.current(cues, stable.register(cues.where(late), path, "cue_id"), "cue_id")


def _p4(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return stable.positions(cut(_registry(spark, d)), table(spark, d, "sampling_plans"))


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    """The cues with number, position and how many plans hold each; p4_plans says which positions a plan holds."""
    return _p4(spark, d)[0].withColumnRenamed("id", "cue_id")


def p4_plans(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d)[1]


def p4_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d)[1].select("plan_id", "n_chosen")


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    """The samples of the plans asked for: every plan whose id is divisible by 100."""
    asked = table(spark, d, "sampling_plans").where("plan_id % 100 = 0")
    return stable.members(_registry(spark, d), asked).withColumnRenamed("id", "cue_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return formatdup.pairs(table(spark, d, "doc_records"))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return formatdup.collapsed(table(spark, d, "doc_records")).withColumnRenamed("record_id", "doc_id")


def p5_text_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs that agree as running text; p5_found adds those that agree as lists."""
    return formatdup.pairs(table(spark, d, "doc_records"), kinds=("text",))


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    """Sums over the records: none of the ids and deliveries is lost."""
    return formatdup.collapsed(table(spark, d, "doc_records")).agg(F.sum("n_copies").alias("n_ids"), F.sum("n_rows").alias("n_rows"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    """The ids decoded again: the MD5 of what they stand for, to compare with that of the texts."""
    decoded = bpe.decode(p6_ids(spark, d))
    return decoded.select("doc_id", F.md5("bytes").alias("md5"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    sized = cut(bpe.token_counts(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "n_tokens"))
    return packing.containers(sized, table(spark, d, "pack_profiles"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fills(p7_containers(spark, d), table(spark, d, "pack_profiles"))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """By profile: documents packed, containers too full, documents cut without need or packed twice, unsettled searches."""
    packed = cut(p7_containers(spark, d).join(F.broadcast(table(spark, d, "pack_profiles")), "profile_id"))
    over = packed.groupBy("profile_id", "container_id", "capacity").agg(F.sum("n_tokens").alias("n"), F.min("settled").alias("settled"))
    over = over.groupBy("profile_id").agg(F.count_if(F.col("n") > F.col("capacity")).alias("n_over"), F.count_if(~F.col("settled")).alias("n_unsettled"))
    docs = packed.groupBy("profile_id", "doc_id", "capacity").agg(F.count("*").alias("k"), F.count_distinct("piece").alias("pieces"), F.sum("n_tokens").alias("n"))
    docs = docs.groupBy("profile_id").agg(F.count("*").alias("n_docs"), F.count_if((F.col("k") > 1) & (F.col("n") <= F.col("capacity"))).alias("n_cut"), F.count_if(F.col("k") > F.col("pieces")).alias("n_twice"))
    return docs.join(over, "profile_id")


def _p8(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "source", "text")
    return abuse.score(documents, model=abuse.adapted(documents))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _p8(spark, d).where(F.col("score") >= abuse.THRESHOLD).select("doc_id").distinct()


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return _p8(spark, d).select("doc_id", F.round("score", 6).alias("score"))


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    return abuse.source_rates(_p8(spark, d))


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """By source: documents, scores from 0 to 1, and null, empty and blank texts, which score 0."""
    scored = _p8(spark, d)
    blank = F.coalesce(proportional.stripped(F.col("text")) == "", F.lit(True))
    return scored.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(F.col("score").between(0, 1)).alias("n_scored"), F.count_if(blank & (F.col("score") == 0)).alias("n_blank"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_sample, p1_drawn, p2_found, p2_items, p2_annotators, p2_votes, p2_coverage, p3_found, p3_letters, p4_sample, p4_plans, p4_sizes, p4_members, p5_found, p5_text_pairs, p5_records, p5_totals, p6_ids, p6_texts, p7_containers, p7_fill, p7_checks, p8_found, p8_scores, p8_sources, p8_counts)}

_STRIP = r"lower(regexp_replace({}, '^[\s\x1c-\x1f\x{{85}}\pZ]+|[\s\x1c-\x1f\x{{85}}\pZ]+$', '', 'g'))"
_P1 = f"""
WITH units AS (
  SELECT DISTINCT r.batch_id, a.field, a.category, r.unit_id FROM (
    SELECT batch_id, doc_id AS unit_id, 'country' AS field, country AS v FROM doc_records
    UNION ALL SELECT batch_id, doc_id, 'seniority', seniority FROM doc_records
    UNION ALL SELECT batch_id, cue_id, 'pos', pos FROM tagged_cues) r
  JOIN category_aliases a ON a.field = r.field AND a.alias = {_STRIP.format("r.v")}),
have AS (SELECT batch_id, field, category, count(*) AS n FROM units GROUP BY ALL),
cells AS (
  SELECT t.plan_id, t.category, round(t.target_share * p.requested, 6) AS target, t.min_rows,
         coalesce(h.n, 0) AS available
  FROM plan_targets t JOIN sampling_plans p USING (plan_id)
  LEFT JOIN have h ON h.batch_id = p.batch_id AND h.field = p.field AND h.category = t.category)
"""
_START = "(('0x' || substr(sha256('seed:' || seed::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0)"
_P4 = f"""
WITH reg AS (SELECT DISTINCT cue_id, ('0x' || substr(sha256(cue_id), 1, 13))::BIGINT / 4503599627370496.0 AS prn
             FROM tagged_cues WHERE cue_id IS NOT NULL),
plan AS (SELECT DISTINCT plan_id, rate, {_START} AS a FROM sampling_plans),
held AS (SELECT cue_id, plan_id FROM reg, plan WHERE prn - a + (CASE WHEN prn < a THEN 1 ELSE 0 END) < rate)
"""
# letters, marks and digits; invisible ones among them listed, as RE2 has no property for them
_PLAIN = r"""regexp_replace(text_raw, '[^\pL\pM\pN]+|[\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180D}\x{180F}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}]+', '', 'g')"""
_P5 = f"""
WITH plain AS (SELECT DISTINCT doc_id, nfc_normalize(replace(replace(lower(nfc_normalize({_PLAIN})), 'ß', 'ss'), 'ς', 'σ')) AS t
               FROM doc_records WHERE doc_id IS NOT NULL AND text_raw IS NOT NULL)
"""
_P2 = f"""
WITH said AS (SELECT item_id, annotator_id, coalesce(seq, -9223372036854775807) AS seq,
    list_position(['applicant', 'non_applicant', 'unclear'], regexp_replace({_STRIP.format("answer")}, '(?:[\\s\\x1c-\\x1f\\x{{85}}\\pZ]|[-_‐-―])+', '_', 'g')) AS label
  FROM annotation_responses WHERE item_id IS NOT NULL AND annotator_id IS NOT NULL),
votes AS (SELECT item_id, annotator_id, ['applicant', 'non_applicant', 'unclear'][max({{'seq': seq, 'label': label}}).label] AS answer FROM said WHERE label > 0 GROUP BY 1, 2)
"""
_BARE = "length(regexp_replace(text, '[^\\pL\\pN]+', '', 'g'))"
ORACLES = {
    "p3_letters": f"""SELECT kind, count(*) AS n_texts, sum({_BARE})::BIGINT AS n_letters, sum({_BARE})::BIGINT AS n_inside FROM (
    SELECT DISTINCT 'doc' AS kind, doc_id AS id, text_norm AS text FROM doc_records WHERE text_norm IS NOT NULL
    UNION ALL SELECT DISTINCT 'cue', cue_id, sentence_context FROM tagged_cues WHERE sentence_context IS NOT NULL) GROUP BY kind""",
    "p6_texts": "SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents",
    "p7_checks": """SELECT profile_id, count(DISTINCT doc_id) AS n_docs, 0::BIGINT AS n_cut, 0::BIGINT AS n_twice, 0::BIGINT AS n_over, 0::BIGINT AS n_unsettled
    FROM pack_profiles, documents WHERE capacity > 0 GROUP BY profile_id""",
    "p8_counts": f"""SELECT source, count(*) AS n_docs, count(*) AS n_scored, count(*) FILTER (coalesce({_STRIP.format("text")}, '') = '') AS n_blank FROM documents GROUP BY source""",
    "p1_drawn": _P1
    + """SELECT plan_id, category, n AS n_drawn, n AS n_units FROM (
    SELECT plan_id, category, least(available, greatest(target, min_rows))::BIGINT AS n FROM cells) WHERE n > 0""",
    "p2_votes": _P2 + "SELECT * FROM votes",
    "p2_coverage": _P2 + "SELECT n::INT AS n_annotators, count(*) AS n_items, count(*) AS n_labelled FROM (SELECT count(*) AS n FROM votes GROUP BY item_id) GROUP BY 1",
    "p5_text_pairs": _P5 + "SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM plain a JOIN plain b ON a.t = b.t AND a.doc_id < b.doc_id WHERE a.t <> ''",
    "p5_totals": "SELECT count(DISTINCT doc_id) AS n_ids, count(doc_id)::BIGINT AS n_rows FROM doc_records",
    "p1_found": _P1 + "SELECT plan_id, category FROM cells WHERE available < greatest(target, min_rows)",
    "p1_report": _P1
    + """SELECT plan_id, category, target, min_rows, available,
    least(available, greatest(target, min_rows))::BIGINT AS drawn, available >= greatest(target, min_rows) AS met FROM cells""",
    "p4_sample": _P4
    + """SELECT cue_id, prn, row_number() OVER (ORDER BY prn, cue_id) - 1 AS position, n AS n_plans FROM (
    SELECT cue_id, any_value(prn) AS prn, count(plan_id) AS n FROM reg LEFT JOIN held USING (cue_id) GROUP BY cue_id)""",
    "p4_plans": _P4
    + """SELECT p.plan_id, CASE WHEN p.rate >= 1 OR n = 0 THEN 0 WHEN p.rate > 0 THEN below % n END AS first, coalesce(h.k, 0) AS n_chosen
    FROM (SELECT plan_id, rate, (SELECT count(*) FROM reg WHERE prn < a) AS below, (SELECT count(*) FROM reg) AS n FROM plan) p
    LEFT JOIN (SELECT plan_id, count(*) AS k FROM held GROUP BY 1) h USING (plan_id)""",
    "p4_members": _P4 + "SELECT plan_id, cue_id FROM held WHERE plan_id % 100 = 0",
    "p4_sizes": _P4 + "SELECT plan.plan_id, count(held.cue_id) AS n_chosen FROM plan LEFT JOIN held USING (plan_id) GROUP BY ALL",
}

"""The core queries over the test tables and the SQL they are checked against.

Each query reads whole tables. Doubles are rounded to six decimals on both
sides. Tables stand in for inputs the tables don't hold: lineitem's orders
for token sequences and for paired scores (declared at each query).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarisk.functions import cues, stats, text
from tamarisk.operators import annotation, blinding, classify, freeze, inference, prevalence, reporting, sampling, scoring, target, twins, validate, variance
from tamarisk.session import broadcast_if_small, scratch_path, table
from tamarisk.sources import corpus
from tamarisk.sources.log import AnnotationLog

QUERIES: dict = {}
ORACLES: dict = {}
HIGH, LOW = 0.70, 0.30
#: Over-sampled error classes and their weight.
OVERSAMPLE = {"مطلوبة": 3.0, "مطلوب": 3.0, "المتقدم": 3.0, "المتقدمة": 3.0}
#: Published masses (label, mass_r, mass_i, expected) of nine fixtures.
CASES = (
    ("A01", 0.7465, 0.2535, "r"), ("A02", 0.8954, 0.1046, "r"), ("A03", 0.7465, 0.2535, "r"),
    ("A04", 0.0, 0.9039, "i"), ("A05", 0.0, 1.0, "i"), ("A06", 0.0, 0.9524, "i"), ("A07", 0.0, 1.0, "i"),
    ("B01", 0.3243, 0.6757, None), ("B02", 0.3184, 0.6816, None),
)
KEY = b"an example key of 32 bytes......"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(c):
    return F.round(c, 6)


# --- candidates: token_analyses, and the cues that use them -----------------

_LIST = "list_sum(list_transform(list_filter(candidates, lambda c: {0}), lambda c: c.score))"
_TOTAL = "coalesce(" + _LIST.format("true") + ", 0)"


def _mass_sql(k: str) -> str:
    own = _LIST.format(f"c.rat = '{k}'")
    return f"CASE WHEN {_TOTAL} > 0 AND len(list_filter(candidates, lambda c: c.rat = '{k}')) > 0 THEN {own} / {_TOTAL} END"


@query("SELECT token, " + ", ".join(f"round({_mass_sql(k)}, 6) AS mass_{k}" for k in "rin") + " FROM token_analyses")
def rationality_mass(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "token_analyses").select("token", cues.rationality_mass(F.col("candidates")).alias("m"))
    return t.select("token", *[r6(F.col(f"m.{k}")).alias(f"mass_{k}") for k in "rin"])


@query("SELECT token, len(list_filter(candidates, lambda c: c.gen = 'm')) > 0 AND len(list_filter(candidates, lambda c: c.gen = 'f')) > 0 AS disagrees FROM token_analyses")
def gender_disagreement(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "token_analyses").select("token", cues.gender_disagreement(F.col("candidates")).alias("disagrees"))


@query("""SELECT token, (SELECT c.gen FROM (SELECT unnest(candidates) AS c) WHERE c.gen IN ('m', 'f')
ORDER BY c.score DESC NULLS LAST, c.gen DESC LIMIT 1) AS gender FROM token_analyses""")
def dominant_gender(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "token_analyses").select("token", cues.dominant_gender(F.col("candidates")).alias("gender"))


@query("""WITH c AS (SELECT coalesce(candidates[1].pos IN ('noun', 'noun_prop', 'adj', 'verb', 'adj_comp', 'noun_quant'), false)
  AND len(list_filter(candidates, lambda x: x.gen IN ('m', 'f'))) > 0 AS is_cue, candidates[1].pos AS top_pos, candidates[1].stemcat AS top_stemcat
  FROM tagged_cues t JOIN token_analyses USING (token))
SELECT top_pos, top_stemcat, is_cue, count(*) AS n FROM c GROUP BY ALL""")
def cue_filter(spark: SparkSession, d: str) -> DataFrame:
    analyses = table(spark, d, "token_analyses").select("token", cues.top(F.col("candidates"), "pos").alias("top_pos"), cues.top(F.col("candidates"), "stemcat").alias("top_stemcat"), cues.is_cue(F.col("candidates")).alias("is_cue"))
    rows = table(spark, d, "tagged_cues").select("token").join(broadcast_if_small(analyses), "token")
    return rows.groupBy("top_pos", "top_stemcat", "is_cue").agg(F.count("*").alias("n"))


def _classified(spark: SparkSession, d: str) -> DataFrame:
    analyses = table(spark, d, "token_analyses").select("token", "candidates", cues.top(F.col("candidates"), "pos").alias("pos"))
    rows = table(spark, d, "tagged_cues").select("cue_id", "token", "gen", "form_gen").join(broadcast_if_small(analyses), "token")
    return classify.classify(rows, classify.Thresholds(HIGH, LOW))


_VERDICT = f"""
WITH x AS (SELECT t.cue_id, t.gen, t.form_gen, candidates, candidates[1].pos AS pos, coalesce({_mass_sql("r")}, 0) AS r, coalesce({_mass_sql("i")}, 0) AS i
  FROM tagged_cues t JOIN token_analyses USING (token)),
v AS (SELECT cue_id, CASE WHEN pos IN ('verb', 'adj', 'adj_comp') THEN 'C|PENDING|'
  WHEN len(list_filter(candidates, lambda c: c.gen = 'm')) > 0 AND len(list_filter(candidates, lambda c: c.gen = 'f')) > 0 THEN 'A|ABSTAIN|AB4'
  WHEN gen IN ('m', 'f') AND form_gen IN ('m', 'f') AND gen <> form_gen THEN 'A|ABSTAIN|AB5'
  WHEN NOT ((r >= {HIGH} AND i < {LOW}) OR (i >= {HIGH} AND r < {LOW})) THEN 'B|ABSTAIN|AB1'
  WHEN i >= {HIGH} THEN 'A|non_applicant|' ELSE 'A|ABSTAIN|AB6' END AS v FROM x)
"""


@query(_VERDICT + "SELECT split_part(v, '|', 1) AS tier, split_part(v, '|', 2) AS referent, nullif(split_part(v, '|', 3), '') AS abstain_reason, count(*) AS n FROM v GROUP BY ALL")
def classify_counts(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).groupBy("tier", "referent", "abstain_reason").agg(F.count("*").alias("n"))


_ORDERED = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS index FROM lineitem"
_POS = "CASE l_partkey % 7 WHEN 0 THEN 'noun' WHEN 1 THEN 'adj' WHEN 2 THEN 'conj' WHEN 3 THEN 'noun_prop' WHEN 4 THEN 'punc' WHEN 5 THEN 'adj' ELSE 'prep' END"


@query("""WITH s AS (SELECT l_orderkey, sum(l_quantity) AS total, sum(l_quantity) FILTER (l_returnflag = 'R') AS r,
  sum(l_quantity) FILTER (l_returnflag = 'A') AS i, sum(l_quantity) FILTER (l_returnflag = 'N') AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey AS token_id, round(r / total, 6) AS mass_r, round(i / total, 6) AS mass_i, round(n / total, 6) AS mass_n FROM s WHERE total > 0""")
def rationality_mass_long(spark: SparkSession, d: str) -> DataFrame:
    """Masses of candidates that are rows: orders stand for tokens, lines for candidates."""
    q = F.col("l_quantity").cast("decimal(20,6)")
    own = lambda f: F.sum(F.when(F.col("l_returnflag") == f, q)).cast("double")
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(q).cast("double").alias("t"), own("R").alias("r"), own("A").alias("i"), own("N").alias("n"))
    return s.where("t > 0").select(F.col("l_orderkey").alias("token_id"), *[r6(F.col(k) / F.col("t")).alias(f"mass_{k}") for k in "rin"])


def _sequence(spark: SparkSession, d: str) -> DataFrame:
    """Orders as sentences, lines as tokens."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("sentence_id"), (F.row_number().over(order) - 1).alias("index"),
        F.expr(_POS).alias("pos"), F.when(F.col("l_linestatus") == "F", "f").otherwise("m").alias("gen"),
    )


@query(f"""WITH t AS (SELECT l_orderkey AS s, index, {_POS} AS pos, CASE WHEN l_linestatus = 'F' THEN 'f' ELSE 'm' END AS gen FROM ({_ORDERED})),
h AS (SELECT a.s, a.index, a.gen, max(b.index) AS head FROM t a LEFT JOIN t b ON b.s = a.s AND b.index < a.index AND b.pos NOT IN ('conj', 'adj', 'punc')
  WHERE a.pos IN ('adj', 'adj_comp') GROUP BY ALL),
o AS (SELECT h.*, CASE WHEN h.index = 0 THEN 'initial' WHEN head IS NULL THEN 'none' WHEN x.pos NOT IN ('noun', 'noun_prop', 'noun_quant') THEN 'blocked'
  WHEN x.gen <> h.gen THEN 'disagrees' WHEN p.pos IN ('noun', 'noun_prop', 'noun_quant') AND p.gen = h.gen THEN 'two_compete' ELSE 'target' END AS outcome
  FROM h LEFT JOIN t x ON x.s = h.s AND x.index = h.head LEFT JOIN t p ON p.s = h.s AND p.index = h.head - 1)
SELECT s AS sentence_id, index, outcome, CASE WHEN outcome = 'target' THEN head END AS target_index,
  CASE WHEN outcome = 'two_compete' THEN head - 1 END AS competitor_index, CASE WHEN outcome <> 'target' THEN 'AB2' END AS abstain_reason FROM o""")
def agreement_target(spark: SparkSession, d: str) -> DataFrame:
    return target.agreement_targets(_sequence(spark, d))


_GRID = "SELECT h.h / 200.0 AS theta_high, l.l / 200.0 AS theta_low FROM range(201) h(h), range(201) l(l) WHERE l.l <= h.h"
_CASES = "VALUES " + ", ".join(f"('{a}', {b}::DOUBLE, {c}::DOUBLE, {repr(e) if e else 'NULL'})" for a, b, c, e in CASES)
_SWEEP = f"""WITH g AS ({_GRID}), c(label, r, i, want) AS ({_CASES}),
s AS (SELECT g.*, label, (CASE WHEN r >= theta_high AND i < theta_low THEN 'r' WHEN i >= theta_high AND r < theta_low THEN 'i' END) IS NOT DISTINCT FROM want AS ok FROM g, c)
"""


def _swept(spark: SparkSession) -> DataFrame:
    cases = spark.createDataFrame(list(CASES), "label string, mass_r double, mass_i double, expected string")
    return classify.sweep(classify.grid(spark, 200), cases)


@query(_SWEEP + "SELECT theta_high, theta_low FROM s GROUP BY ALL HAVING bool_and(ok)")
def theta_sweep_feasible(spark: SparkSession, d: str) -> DataFrame:
    return classify.feasible(_swept(spark))


@query(_SWEEP + "SELECT label, count(*) FILTER (NOT ok) AS n_failures FROM s GROUP BY label")
def theta_sweep_failures(spark: SparkSession, d: str) -> DataFrame:
    return classify.failures(_swept(spark))


@query(_SWEEP + ", f AS (SELECT theta_high, theta_low FROM s GROUP BY ALL HAVING bool_and(ok)) SELECT min(theta_high) AS min_theta_high, max(theta_high) AS max_theta_high, min(theta_low) AS min_theta_low, max(theta_low) AS max_theta_low FROM f")
def theta_sweep_ranges(spark: SparkSession, d: str) -> DataFrame:
    return classify.ranges(classify.feasible(_swept(spark)))


# --- twins: the feminine and masculine cues of a document --------------------

def _twins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tagged_cues").select("cue_id", F.col("doc_id").alias("pair_id"), F.col("gen").alias("side"), "char_start", "tier", "referent", "abstain_reason", "gen").distinct()
    return rows.select("*", F.col("char_start").alias("token_index"))


_TWINS = """WITH t AS (SELECT DISTINCT cue_id, doc_id, gen, char_start, tier, referent, abstain_reason FROM tagged_cues),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, gen ORDER BY char_start, tier NULLS FIRST, referent NULLS FIRST, abstain_reason NULLS FIRST) - 1 AS pos FROM t WHERE gen IN ('f', 'm')),
n AS (SELECT doc_id, count(*) FILTER (gen = 'f') AS nf, count(*) FILTER (gen = 'm') AS nm FROM t GROUP BY 1),
j AS (SELECT f.doc_id, f.pos, f.tier AS ft, m.tier AS mt, f.referent AS fr, m.referent AS mr, f.abstain_reason AS fa, m.abstain_reason AS ma FROM p f JOIN p m ON f.doc_id = m.doc_id AND f.pos = m.pos AND f.gen = 'f' AND m.gen = 'm'),
a AS (SELECT doc_id AS pair_id, 'tier' AS kind, pos AS position, ft AS value_f, mt AS value_m FROM j WHERE ft IS DISTINCT FROM mt
  UNION ALL SELECT doc_id, 'referent', pos, fr, mr FROM j WHERE fr IS DISTINCT FROM mr
  UNION ALL SELECT doc_id, 'abstain_trigger', pos, fa, ma FROM j WHERE fa IS DISTINCT FROM ma
  UNION ALL SELECT doc_id, 'cue_count', NULL, nf::VARCHAR, nm::VARCHAR FROM n WHERE nf <> nm)
"""


@query(_TWINS + "SELECT * FROM a")
def twin_asymmetries(spark: SparkSession, d: str) -> DataFrame:
    return twins.asymmetries(_twins(spark, d))


@query(_TWINS + "SELECT n.doc_id AS pair_id, nf AS n_f, nm AS n_m, count(a.kind) AS n_asymmetries, count(a.kind) = 0 AS symmetric FROM n LEFT JOIN a ON a.pair_id = n.doc_id GROUP BY ALL")
def twin_symmetry(spark: SparkSession, d: str) -> DataFrame:
    return twins.report(_twins(spark, d))


@query(_TWINS + "SELECT doc_id AS pair_id, nf > 0 AND nm > 0 AS genders_differ FROM n")
def genders_differ(spark: SparkSession, d: str) -> DataFrame:
    return twins.genders_differ(_twins(spark, d))


# --- documents ---------------------------------------------------------------

@query("SELECT record_seq, sha256(nfc_normalize(text_raw)) AS nfc_sha FROM doc_records")
def nfc_text(spark: SparkSession, d: str) -> DataFrame:
    rows = text.nfc(table(spark, d, "doc_records").select("record_seq", "text_raw"), "text_raw", "nfc")
    return rows.select("record_seq", text.checksum(F.col("nfc")).alias("nfc_sha"))


@query("SELECT record_seq, substr(sha256(text_raw), 1, 16) AS content_id, substr(sha256(text_raw), 1, 16) = doc_id AS same FROM doc_records")
def content_ids(spark: SparkSession, d: str) -> DataFrame:
    cid = text.content_id(F.col("text_raw"))
    return table(spark, d, "doc_records").select("record_seq", cid.alias("content_id"), (cid == F.col("doc_id")).alias("same"))


_WORDS = r"len(list_filter(regexp_split_to_array(text_norm, '[\s\x0b\x1c-\x1f\x{85}\pZ]+'), lambda w: w <> ''))"


@query(f"""WITH r AS (SELECT country, coalesce(nullif(occupation, ''), '(unspecified)') AS occupation, length(text_norm) AS chars, {_WORDS} AS tokens FROM doc_records),
g AS (SELECT grouping(country, occupation) AS g, country, occupation, count(*) AS n, avg(chars) AS c, avg(tokens) AS t FROM r GROUP BY GROUPING SETS ((), (country), (occupation)))
SELECT CASE g WHEN 3 THEN 'all' WHEN 1 THEN 'country' ELSE 'occupation' END AS dimension, CASE g WHEN 3 THEN 'all' WHEN 1 THEN country ELSE occupation END AS value,
n, round(c, 6) AS mean_chars, round(t, 6) AS mean_tokens FROM g""")
def corpus_describe(spark: SparkSession, d: str) -> DataFrame:
    out = corpus.describe(table(spark, d, "doc_records"))
    return out.withColumn("mean_chars", r6("mean_chars")).withColumn("mean_tokens", r6("mean_tokens"))


@query("SELECT occupation AS category, count(*) AS n FROM doc_records WHERE occupation IS NOT NULL GROUP BY 1 ORDER BY n DESC, category LIMIT 10")
def corpus_top_categories(spark: SparkSession, d: str) -> DataFrame:
    return corpus.top_categories(table(spark, d, "doc_records"))


@query("SELECT coalesce(nullif(trim(seniority), ''), 'unknown') AS label, count(*) AS n FROM doc_records WHERE trim(text_raw) <> '' GROUP BY 1")
def source_label_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.label_counts(table(spark, d, "doc_records"), "seniority", "text_raw")


@query("""SELECT cue_id, sentence_context[:a] || '«' || sentence_context[a + 1:b] || '»' || sentence_context[b + 1:] AS rendered
FROM (SELECT DISTINCT cue_id, sentence_context, instr(sentence_context, token) - 1 AS a, instr(sentence_context, token) - 1 + length(token) AS b FROM tagged_cues WHERE instr(sentence_context, token) > 0)""")
def annotation_render(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tagged_cues").select("cue_id", "sentence_context", "token").distinct()
    at = text.spans(F.col("sentence_context"), F.array("token"))
    rows = rows.where(F.col("sentence_context").contains(F.col("token"))).withColumn("s", F.get(at, F.lit(0)))
    return rows.select("cue_id", text.render(F.col("sentence_context"), F.col("s.char_start"), F.col("s.char_end")).alias("rendered"))


@query("""SELECT cue_id, rule, count(*) AS n FROM (
  SELECT cue_id, 'ABSTAIN without reason or reason without ABSTAIN' AS rule FROM tagged_cues WHERE (coalesce(referent, '') = 'ABSTAIN') <> (abstain_reason IS NOT NULL)
  UNION ALL SELECT cue_id, 'head token outside tier C' FROM tagged_cues WHERE head_token IS NOT NULL AND coalesce(tier, '') <> 'C'
  UNION ALL SELECT cue_id, 'gen is unknown' FROM tagged_cues WHERE gen NOT IN ('m', 'f')
  UNION ALL SELECT cue_id, 'tier is unknown' FROM tagged_cues WHERE tier NOT IN ('A', 'B', 'C')
  UNION ALL SELECT cue_id, 'referent is unknown' FROM tagged_cues WHERE referent NOT IN ('applicant', 'non_applicant', 'ABSTAIN')
  UNION ALL SELECT cue_id, 'abstain_reason is unknown' FROM tagged_cues WHERE abstain_reason NOT IN ('AB1', 'AB2', 'AB3', 'AB4', 'AB5', 'AB6')
  UNION ALL SELECT cue_id, 'empty or negative span' FROM tagged_cues WHERE char_start < 0 OR char_end <= char_start) GROUP BY ALL""")
def cue_violations(spark: SparkSession, d: str) -> DataFrame:
    return validate.violations(table(spark, d, "tagged_cues"), "cue_id").groupBy("cue_id", "rule").agg(F.count("*").alias("n"))


# --- annotations ---------------------------------------------------------------

_ANSWERS = r"""WITH s AS (SELECT seq, item_id, annotator_id, regexp_replace(lower(trim(answer)), '[\s_-]+', '_', 'g') AS answer FROM annotation_responses),
v AS (SELECT * FROM s WHERE answer IN ('applicant', 'non_applicant', 'unclear')),
l AS (SELECT annotator_id, item_id, max_by(answer, seq) AS answer, max(seq) AS seq FROM v GROUP BY ALL)
"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return annotation.answers(table(spark, d, "annotation_responses"), strict=False)


@query(_ANSWERS + "SELECT * FROM l")
def annotator_last_answers(spark: SparkSession, d: str) -> DataFrame:
    return annotation.last_answers(_answers(spark, d))


@query(_ANSWERS + "SELECT annotator_id, count(*) AS n_answers, count(DISTINCT item_id) AS n_items, min(seq) AS first_seq, max(seq) AS last_seq FROM v GROUP BY 1")
def annotator_summary(spark: SparkSession, d: str) -> DataFrame:
    return annotation.by_annotator(_answers(spark, d))


@query(_ANSWERS + "SELECT item_id, count(DISTINCT annotator_id) AS n_annotators FROM v GROUP BY 1 HAVING count(DISTINCT annotator_id) >= 2")
def double_annotated(spark: SparkSession, d: str) -> DataFrame:
    return annotation.double_annotated(_answers(spark, d))


@query(_ANSWERS + "SELECT round(coalesce(avg((answer = 'unclear')::INT), 0), 6) AS unclear_rate FROM v")
def unclear_rate(spark: SparkSession, d: str) -> DataFrame:
    return annotation.unclear_rate(_answers(spark, d)).select(r6("unclear_rate").alias("unclear_rate"))


_KAPPA = _ANSWERS + """, j AS (SELECT a.annotator_id AS annotator_a, b.annotator_id AS annotator_b, a.answer AS x, b.answer AS y FROM l a JOIN l b ON a.item_id = b.item_id AND a.annotator_id < b.annotator_id),
k AS (SELECT annotator_a, annotator_b, count(*) AS n_items, avg((x = y)::INT) AS po,
  sum((x = 'applicant')::INT) * sum((y = 'applicant')::INT) / count(*)::DOUBLE ^ 2 + sum((x = 'non_applicant')::INT) * sum((y = 'non_applicant')::INT) / count(*)::DOUBLE ^ 2
  + sum((x = 'unclear')::INT) * sum((y = 'unclear')::INT) / count(*)::DOUBLE ^ 2 AS pe, (sum((x = 'unclear')::INT) + sum((y = 'unclear')::INT)) / (2.0 * count(*)) AS u FROM j GROUP BY 1, 2),
g AS (SELECT annotator_a, annotator_b, n_items, round(po, 6) AS po, round(pe, 6) AS pe, CASE WHEN pe < 1 THEN round((po - pe) / (1 - pe), 6) END AS kappa, round(u, 6) AS unclear_rate,
  CASE WHEN pe >= 1 THEN 'chance agreement is 1' END AS undefined_reason FROM k)
"""


def _kappas(spark: SparkSession, d: str) -> DataFrame:
    k = annotation.kappa_pairs(_answers(spark, d))
    return k.select("annotator_a", "annotator_b", "n_items", *[r6(c).alias(c) for c in ("po", "pe", "kappa", "unclear_rate")], "undefined_reason")


@query(_KAPPA + "SELECT * FROM g")
def kappa_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _kappas(spark, d)


@query(_KAPPA + "SELECT annotator_a, annotator_b, kappa, CASE WHEN kappa IS NULL THEN 'undefined' WHEN kappa < 0.7 THEN 'below_floor' ELSE 'usable' END AS gate_status FROM g")
def kappa_gate(spark: SparkSession, d: str) -> DataFrame:
    return annotation.gate_status(_kappas(spark, d)).select("annotator_a", "annotator_b", "kappa", "gate_status")


@query(_ANSWERS + """, q AS (SELECT item_id, list(answer ORDER BY annotator_id) AS p FROM l GROUP BY 1 HAVING count(*) >= 2)
SELECT item_id, CASE WHEN p[1] = p[2] THEN p[1] WHEN p[3] IN (p[1], p[2]) THEN p[3] ELSE 'unclear' END AS answer FROM q WHERE p[1] = p[2] OR p[3] IS NOT NULL""")
def adjudicate(spark: SparkSession, d: str) -> DataFrame:
    return annotation.adjudicated(_answers(spark, d))


@query(_ANSWERS + "SELECT DISTINCT item_id FROM annotation_items WHERE item_id NOT IN (SELECT item_id FROM v WHERE annotator_id = 'A03')")
def todo_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return annotation.todo(table(spark, d, "annotation_items").select("item_id").distinct(), _answers(spark, d), "A03")


@query("""SELECT DISTINCT substr(sha256('item:' || cue_id), 1, 12) AS item_id, sentence_context AS sentence, char_start AS cue_start, char_end AS cue_end, doc_type
FROM tagged_cues JOIN (SELECT doc_id, any_value(doc_type) AS doc_type FROM doc_records GROUP BY 1) USING (doc_id)""")
def blind_items(spark: SparkSession, d: str) -> DataFrame:
    opaque = F.substring(F.sha2(F.concat(F.lit("item:"), "cue_id"), 256), 1, 12)
    return annotation.blind_items(table(spark, d, "tagged_cues"), table(spark, d, "doc_records"), opaque).distinct()


# --- sampling --------------------------------------------------------------------

_FIELDS = ["gen", "tier", "abstain_reason"]
_SIZE, _SEED = 500, 17
_STRATA = f"""WITH c AS (SELECT cue_id, any_value(token) AS token, any_value(gen) AS gen, any_value(tier) AS tier, any_value(abstain_reason) AS abstain_reason FROM (SELECT DISTINCT cue_id, token, gen, tier, abstain_reason FROM tagged_cues) GROUP BY 1 HAVING count(*) = 1),
e AS (SELECT *, CASE WHEN token IN ({", ".join(f"'{t}'" for t in OVERSAMPLE)}) THEN token END AS error_class FROM c),
k AS (SELECT *, concat_ws('|', coalesce(gen, '\\N'), coalesce(tier, '\\N'), coalesce(abstain_reason, '\\N'), coalesce(error_class, '\\N')) AS stratum FROM e),
s AS (SELECT stratum, count(*) AS available, count(*) * CASE WHEN any_value(error_class) IS NULL THEN 1.0 ELSE 3.0 END AS w FROM k GROUP BY 1),
r AS (SELECT *, round({_SIZE}::DOUBLE * w / sum(w) OVER (), 9) AS raw FROM s),
q AS (SELECT *, floor(raw)::BIGINT + (row_number() OVER (ORDER BY raw - floor(raw) DESC, stratum) <= {_SIZE} - sum(floor(raw)) OVER ())::BIGINT AS quota FROM r),
t AS (SELECT stratum, available, quota, least(quota, available) AS take FROM q)
"""


def _cue_frame(spark: SparkSession, d: str) -> DataFrame:
    """Cues whose tagging is the same wherever they occur."""
    rows = table(spark, d, "tagged_cues").select("cue_id", "token", *_FIELDS).distinct()
    one = rows.groupBy("cue_id").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("token", *_FIELDS)])
    return one.where("n = 1").drop("n")


@query(_STRATA + "SELECT * FROM t")
def strata_quotas(spark: SparkSession, d: str) -> DataFrame:
    return sampling.quotas(_cue_frame(spark, d), _FIELDS, _SIZE, OVERSAMPLE).select("stratum", "available", "quota", "take")


@query(_STRATA + "SELECT stratum, quota, available FROM t WHERE take < quota")
def sampling_shortfalls(spark: SparkSession, d: str) -> DataFrame:
    return sampling.shortfalls(sampling.quotas(_cue_frame(spark, d), _FIELDS, _SIZE, OVERSAMPLE))


@query(_STRATA + f"SELECT cue_id, stratum FROM (SELECT cue_id, k.stratum, take, row_number() OVER (PARTITION BY k.stratum ORDER BY sha256('{_SEED}:' || cue_id), cue_id) AS rn FROM k JOIN t ON k.stratum = t.stratum) WHERE rn <= take")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.draw(_cue_frame(spark, d), _FIELDS, _SIZE, _SEED, OVERSAMPLE)


# --- blinding, freeze ---------------------------------------------------------------

_PADS = [bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]
_CELLS = f"""WITH c AS (SELECT DISTINCT p_brand AS register, l_linestatus AS polarity, (l_suppkey % 10)::VARCHAR AS pair_id FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT *, 'register=' || register || '|polarity=' || polarity || '|pair=' || pair_id AS cell FROM c),
b AS (SELECT *, substr(sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(cell)))), 1, 32) AS blind_token FROM m),
o AS (SELECT *, row_number() OVER (ORDER BY blind_token, cell) AS position FROM b)
"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    rows = table(spark, d, "lineitem").select("l_partkey", "l_linestatus", "l_suppkey").join(parts, "l_partkey")
    rows = rows.select(F.col("p_brand").alias("register"), F.col("l_linestatus").alias("polarity"), (F.col("l_suppkey") % 10).cast("string").alias("pair_id")).distinct()
    return rows.withColumn("cell", blinding.canonical(F.col("register"), F.col("polarity"), F.col("pair_id")))


@query(_CELLS + "SELECT cell, blind_token FROM b")
def blind_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).select("cell", blinding.token(F.col("cell"), KEY).alias("blind_token"))


@query(_CELLS + "SELECT cell, blind_token, position FROM o")
def blind_order(spark: SparkSession, d: str) -> DataFrame:
    return blinding.blind_order(_cells(spark, d), KEY, F.col("cell"), "cell", in_plan=True).select("cell", "blind_token", "position")


@query(_CELLS + """, r AS (SELECT polarity AS v, lag(polarity) OVER (ORDER BY position) AS w, position FROM o), t AS (SELECT count(*) AS n, count(DISTINCT v) AS n_values, 1 + count(*) FILTER (position > 1 AND v IS DISTINCT FROM w) AS n_runs FROM r)
SELECT n, n_values, n_runs, n_values >= 2 AND (n_runs = n_values OR (n_values = 2 AND n_runs = n)) AS leaks FROM t""")
def ordering_leak(spark: SparkSession, d: str) -> DataFrame:
    return blinding.ordering_leak(blinding.blind_order(_cells(spark, d), KEY, F.col("cell"), "cell", in_plan=True), "polarity")


_MANIFEST = freeze.Manifest(("plan.txt", "code.txt"), "lock.txt", {"theta_high": 0.7, "theta_low": 0.3}, {"ads": "00ff"}, {"model": "1.5.2"})


def _frozen(spark: SparkSession) -> DataFrame:
    return freeze.components(spark, _MANIFEST, lambda path: f"contents of {path}".encode())


@query("""SELECT * FROM (VALUES ('source:plan.txt', sha256('contents of plan.txt')), ('source:code.txt', sha256('contents of code.txt')), ('lockfile:lock.txt', sha256('contents of lock.txt')),
('config', sha256('{theta_high=0.7,theta_low=0.3}')), ('corpus', sha256('{ads=00ff}')), ('models', sha256('{model=1.5.2}'))) t(name, digest)""")
def freeze_components(spark: SparkSession, d: str) -> DataFrame:
    return _frozen(spark)


@query("SELECT sha256(string_agg(k || '=' || v, chr(10) ORDER BY k)) AS freeze_hash FROM (" + ORACLES["freeze_components"].replace("t(name, digest)", "t(k, v)") + ")")
def freeze_hash(spark: SparkSession, d: str) -> DataFrame:
    return freeze.freeze_hash(_frozen(spark))


# --- paired scores: suppliers stand for ads, parts for CV pairs ------------------------

_DIFF = """WITH g AS (SELECT (l_suppkey % 10)::VARCHAR AS a, (l_partkey % 20)::VARCHAR AS p,
  avg(l_extendedprice) FILTER (l_linestatus = 'F') / 1000 AS f, avg(l_extendedprice) FILTER (l_linestatus = 'O') / 1000 AS m FROM lineitem GROUP BY 1, 2),
x AS (SELECT a, p, f - m AS x FROM g), n AS (SELECT count(*) AS n, count(DISTINCT a) AS na, count(DISTINCT p) AS np, avg(x) AS mu, stddev_samp(x) AS sd FROM x),
sa AS (SELECT a, sum(x) AS s, count(*) AS k FROM x GROUP BY 1), sp AS (SELECT p, sum(x) AS s, count(*) AS k FROM x GROUP BY 1),
q AS (SELECT n.*, (SELECT sum((s / k - mu) ^ 2) FROM sa, n) AS ssa, (SELECT sum((s / k - mu) ^ 2) FROM sp, n) AS ssp, (SELECT sum((x - mu) ^ 2) FROM x, n) AS ss,
  (SELECT sum((s - k * mu) ^ 2) FROM sa, n) AS va, (SELECT sum((s - k * mu) ^ 2) FROM sp, n) AS vp FROM n),
c AS (SELECT *, (ss - np * ssa - na * ssp) / ((na - 1) * (np - 1)) AS res, np * ssa / (na - 1) AS msa, na * ssp / (np - 1) AS msp,
  CASE WHEN va + vp - ss > 0 THEN va + vp - ss ELSE greatest(va, vp) END / n::DOUBLE ^ 2 AS v, va + vp - ss > 0 AS two FROM q)
"""


def _differences(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice")
    rows = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).cast("string").alias("ad_id"), (F.col("l_partkey") % 20).cast("string").alias("pair_id")).agg(
        F.avg(F.when(F.col("l_linestatus") == "F", price)).alias("f"), F.avg(F.when(F.col("l_linestatus") == "O", price)).alias("m")
    )
    return rows.select("ad_id", "pair_id", ((F.col("f") - F.col("m")) / 1000).alias("difference"))


@query(_DIFF + "SELECT round(greatest(0, (msa - res) / np), 6) AS sigma2_ad, round(greatest(0, (msp - res) / na), 6) AS sigma2_cv, round(greatest(0, res), 6) AS sigma2_resid, na AS n_ads, np AS n_pairs FROM c")
def anova_components(spark: SparkSession, d: str) -> DataFrame:
    return variance.components(_differences(spark, d)).select(*[r6(c).alias(c) for c in ("sigma2_ad", "sigma2_cv", "sigma2_resid")], "n_ads", "n_pairs")


@query(_DIFF + f"SELECT round(mu, 6) AS mean_difference, round(sqrt(v), 6) AS se, n, na AS n_ads, np AS n_pairs, CASE WHEN two THEN '{variance.CLUSTERING}' ELSE '{variance.CLUSTERING}, larger one-way variance (two-way estimate not positive)' END AS clustering FROM c")
def cluster_robust_se(spark: SparkSession, d: str) -> DataFrame:
    out = variance.cluster_robust(_differences(spark, d))
    return out.withColumn("mean_difference", r6("mean_difference")).withColumn("se", r6("se"))


@query(_DIFF + "SELECT round(sd / sqrt(n), 6) AS naive_se FROM n")
def naive_se(spark: SparkSession, d: str) -> DataFrame:
    return variance.naive_se(_differences(spark, d)).select(r6("naive_se").alias("naive_se"))


@query(_DIFF + "SELECT round(sqrt(v) / (sd / sqrt(n)), 6) AS se_inflation FROM c")
def se_inflation(spark: SparkSession, d: str) -> DataFrame:
    return variance.inflation(_differences(spark, d)).select(r6("se_inflation").alias("se_inflation"))


_SCALES = (1e-12, 1e-6, 1e6, 1e12)


@query(_DIFF + f"""SELECT k AS scale, round(greatest(0, (msa - res) / np), 6) AS sigma2_ad, round(greatest(0, (msp - res) / na), 6) AS sigma2_cv, round(greatest(0, res), 6) AS sigma2_resid,
round(sqrt(v), 6) AS se, two AS two_way, round(sqrt(v) / (sd / sqrt(n)), 6) AS se_inflation FROM c, (SELECT unnest([{", ".join(f"{k}::DOUBLE" for k in _SCALES)}]) AS k)""")
def variance_scales(spark: SparkSession, d: str) -> DataFrame:
    """Components, errors and inflation of the differences times a scale, divided by it again."""
    rows, out = _differences(spark, d), None
    for k in _SCALES:
        scaled = rows.withColumn("difference", F.col("difference") * k)
        parts = variance.components(scaled).select(*[r6(F.col(c) / k / k).alias(c) for c in ("sigma2_ad", "sigma2_cv", "sigma2_resid")])
        error = variance.cluster_robust(scaled).select(r6(F.col("se") / k).alias("se"), (F.col("clustering") == variance.CLUSTERING).alias("two_way"))
        one = parts.join(error).join(variance.inflation(scaled).select(r6("se_inflation").alias("se_inflation"))).withColumn("scale", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


_N_ADS = "SELECT unnest([5, 10, 20, 40, 80, 160]) AS n_ads"


@query(f"SELECT n_ads::BIGINT AS n_ads, round(sqrt(0.5 / n_ads + 0.3 / 50 + 2.0 / (n_ads * 50)), 6) AS predicted_se FROM ({_N_ADS})")
def predicted_se(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(n,) for n in (5, 10, 20, 40, 80, 160)], "n_ads bigint")
    return rows.select("n_ads", r6(variance.predicted_se(F.lit(0.5), F.lit(0.3), F.lit(2.0), F.col("n_ads"), F.lit(50))).alias("predicted_se"))


@query(f"""WITH {_DIFF.removeprefix("WITH ")}, i AS (SELECT mu, sqrt(v) AS se, n, na, np, two FROM c)
SELECT printf('%+.4f [%+.4f, %+.4f] (SE %.4f; %s; n=%d over %d ads x %d pairs)', mu, mu - 1.96 * se, mu + 1.96 * se, se,
CASE WHEN two THEN '{variance.CLUSTERING}' ELSE '{variance.CLUSTERING}, larger one-way variance (two-way estimate not positive)' END, n, na, np) AS text FROM i""")
def interval_text(spark: SparkSession, d: str) -> DataFrame:
    return variance.cluster_robust(_differences(spark, d)).select(reporting.interval_text().alias("text"))


# --- inference -----------------------------------------------------------------------

def _p_values(spark: SparkSession, d: str) -> DataFrame:
    """Made-up p values, with ties: one for each order status, segment and priority."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    rows = table(spark, d, "orders").join(c, "o_custkey").groupBy("o_orderstatus", "c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("k"))
    return rows.select(F.concat(F.lit("status "), "o_orderstatus").alias("family"), F.concat_ws("/", "c_mktsegment", "o_orderpriority").alias("label"), ((F.col("n") * 7 + F.col("k")) % 200 / 4000).alias("p_value"))


@query("""WITH p AS (SELECT 'status ' || o_orderstatus AS family, c_mktsegment || '/' || o_orderpriority AS label, (count(*) * 7 + max(o_orderkey)) % 200 / 4000.0::DOUBLE AS p_value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_orderstatus, c_mktsegment, o_orderpriority),
s AS (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p_value, label) + 1) * p_value AS step FROM p),
a AS (SELECT *, least(1.0, max(step) OVER (PARTITION BY family ORDER BY p_value, label ROWS UNBOUNDED PRECEDING)) AS adj FROM s)
SELECT family, label, round(p_value, 6) AS p_value, round(adj, 6) AS p_adjusted, adj <= 0.05 AS reject FROM a""")
def holm(spark: SparkSession, d: str) -> DataFrame:
    out = inference.holm(_p_values(spark, d))
    return out.withColumn("p_value", r6("p_value")).withColumn("p_adjusted", r6("p_adjusted"))


_TESTS = "SELECT s_suppkey AS id, (s_suppkey % 41 - 20) / 200.0::DOUBLE AS difference, (s_suppkey % 7 + 1) / 50.0::DOUBLE AS se, 0.05::DOUBLE AS margin, (s_suppkey % 60 + 1)::INT AS df FROM supplier"


def _tests(spark: SparkSession, d: str) -> DataFrame:
    """Made-up test statistics, one for each supplier."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), ((k % 41 - 20) / 200).alias("difference"), ((k % 7 + 1) / 50).alias("se"), F.lit(0.05).alias("margin"), (k % 60 + 1).cast("int").alias("df"))


#: The t distribution by Simpson's rule in theta = atan(t / sqrt(df)), 2,000 steps.
_T = """0.5 + exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(pi()) * atan({t} / sqrt(df)) / 6000.0 *
(1 + cos(atan({t} / sqrt(df))) ** (df - 1) + list_sum(list_transform(range(1, 2000), lambda k: (CASE WHEN k % 2 = 1 THEN 4 ELSE 2 END) * cos(atan({t} / sqrt(df)) * k / 2000.0) ** (df - 1))))"""


@query(f"WITH t AS ({_TESTS}), p AS (SELECT *, 1 - ({_T.format(t='((difference + margin) / se)')}) AS lo, {_T.format(t='((difference - margin) / se)')} AS up FROM t) SELECT id, round(lo, 6) AS p_lower, round(up, 6) AS p_upper, round(greatest(lo, up), 6) AS p_value, greatest(lo, up) <= 0.05 AS equivalent FROM p")
def tost(spark: SparkSession, d: str) -> DataFrame:
    out = inference.tost(_tests(spark, d))
    return out.select("id", *[r6(c).alias(c) for c in ("p_lower", "p_upper", "p_value")], "equivalent")


#: The normal distribution by Simpson's rule over [0, x], 2,000 steps.
_PHI = "(0.5 + ({x}) / 6000.0 / sqrt(2 * pi()) * (1 + exp(-0.5 * ({x}) ** 2) + list_sum(list_transform(range(1, 2000), lambda k: (CASE WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * (({x}) * k / 2000.0) ** 2)))))"
_Z = 1.9599639845400536


@query(f"WITH g AS (SELECT n_ads::BIGINT AS n_ads, sqrt(0.5 / n_ads + 0.3 / 50 + 2.0 / (n_ads * 50)) AS se FROM ({_N_ADS})) SELECT n_ads, round(se, 6) AS se, round({_PHI.format(x=f'0.3 / se - {_Z}')} + {_PHI.format(x=f'-0.3 / se - {_Z}')}, 6) AS power FROM g")
def power_curve(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.createDataFrame([(n,) for n in (5, 10, 20, 40, 80, 160, 40)], "n_ads bigint")
    out = inference.power_curve(grid, (0.5, 0.3, 2.0), 0.3, 50)
    return out.select("n_ads", r6("se").alias("se"), r6("power").alias("power"))


@query(f"WITH g AS (SELECT n, sqrt(0.5 / n + 0.3 / 50 + 2.0 / (n * 50)) AS se FROM range(1, 400) t(n)) SELECT min(n) AS n_ads FROM g WHERE {_PHI.format(x=f'0.3 / se - {_Z}')} + {_PHI.format(x=f'-0.3 / se - {_Z}')} >= 0.8")
def required_n_ads(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(inference.required_ads((0.5, 0.3, 2.0), 0.3, 50),)], "n_ads bigint")


@query(f"""WITH t AS (SELECT id::VARCHAR AS label, (id % 101) / 100.0 AS p, 0.5 AS floor, id % 3 = 0 AS eq, id % 2 = 0 AS sig FROM ({_TESTS}))
SELECT label, CASE WHEN p < floor THEN 'inconclusive' WHEN eq THEN 'equivalent-within-margin' WHEN sig THEN 'difference-detected' ELSE 'inconclusive' END AS verdict FROM t""")
def cell_verdicts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    cells = _tests(spark, d).select(k.cast("string").alias("label"), (k % 101 / 100).alias("achieved_power"), F.lit(0.5).alias("power_floor"), (k % 3 == 0).alias("equivalent"), (k % 2 == 0).alias("significant"))
    return reporting.verdicts(cells).select("label", "verdict")


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(lower(text), '\bfair[\s\-]*(ness|ly)', '', 'g') AS x FROM documents)
SELECT doc_id FROM t WHERE regexp_matches(x, '\bno[\s\-_]+bias\b|\bbias[\s\-_]+free\b|\bunbiased\b|\bno[\s\-_]+evidence[\s\-_]+of[\s\-_]+bias\b|\bfair\b')""")
def forbidden_claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(reporting.forbidden(F.col("text"))).select("doc_id")


def _u(part: str) -> str:
    return f"((('0x' || substr(sha256({part}), 1, 13))::BIGINT + 1) / 4503599627370496.0)"


def _norm(part: str) -> str:
    return f"(sqrt(-2 * ln({_u(part + " || '|u'")})) * cos(2 * pi() * {_u(part + " || '|v'")}))"


@query(f"""WITH c AS (SELECT s_suppkey::VARCHAR AS a, n_nationkey::VARCHAR AS p FROM supplier, nation),
e AS (SELECT a, p, 0.8 * {_norm("'5|ad|' || a")} + 0.6 * {_norm("'5|pair|' || p")} AS level, (0.25 + 0.4 * {_norm("'5|ad_gender|' || a")} + 0.3 * {_norm("'5|pair_gender|' || p")}) / 2 AS half FROM c)
SELECT a AS ad_id, p AS pair_id, round(level + half + {_norm("'5|f|' || a || '|' || p")}, 6) AS score_f, round(level - half + {_norm("'5|m|' || a || '|' || p")}, 6) AS score_m FROM e""")
def synthetic_scores(spark: SparkSession, d: str) -> DataFrame:
    model = scoring.Synthetic(effect=0.25, sd_ad=0.8, sd_pair=0.6, sd_ad_gender=0.4, sd_pair_gender=0.3, sd_resid=1.0, seed=5)
    out = model.score_pairs(table(spark, d, "supplier").select("s_suppkey"), table(spark, d, "nation").select("n_nationkey"))
    return out.select("ad_id", "pair_id", r6("score_f").alias("score_f"), r6("score_m").alias("score_m"))


# --- specified analyses (extensions) ------------------------------------------------------

_DOCS = f"SELECT doc_id, any_value(doc_type) AS doc_type, max({_WORDS}) AS words FROM doc_records GROUP BY 1"


@query(f"""WITH d AS ({_DOCS}), c AS (SELECT DISTINCT cue_id, doc_id, referent FROM tagged_cues), e AS (SELECT doc_id, count(*) AS k, count(*) FILTER (referent = 'applicant') AS a, count(*) FILTER (referent = 'ABSTAIN') AS b FROM c GROUP BY 1),
r AS (SELECT d.*, coalesce(k, 0) AS k, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM d LEFT JOIN e USING (doc_id)),
u AS (SELECT 'all' AS dimension, 'all' AS value, * FROM r UNION ALL SELECT 'doc_type', doc_type, * FROM r)
SELECT dimension, value, count(*) AS n_docs, count(*) FILTER (a > 0) AS n_with_applicant, sum(k)::BIGINT AS n_cues, sum(b)::BIGINT AS n_abstained, sum(words)::BIGINT AS n_words,
round(count(*) FILTER (a > 0) / count(*), 6) AS share_with_applicant, round(sum(k) / count(*), 6) AS cues_per_doc, round(100 * sum(k) / sum(words), 6) AS cues_per_100_words FROM u GROUP BY 1, 2""")
def prevalence_table(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "doc_records").groupBy("doc_id").agg(F.max("doc_type").alias("doc_type"), F.max("text_norm").alias("text_norm"))
    found = table(spark, d, "tagged_cues").select("cue_id", "doc_id", "referent").distinct()
    out = prevalence.prevalence(docs, found, ("doc_type",))
    for c in ("share_with_applicant", "cues_per_doc", "cues_per_100_words"):
        out = out.withColumn(c, r6(c))
    return out


@query(_VERDICT + """, g AS (SELECT v.cue_id, split_part(v, '|', 1) AS tier, split_part(v, '|', 2) AS predicted FROM (SELECT DISTINCT * FROM v) v),
t AS (SELECT cue_id, any_value(referent) AS gold, any_value(gen) AS morph_class FROM (SELECT DISTINCT cue_id, referent, gen FROM tagged_cues) GROUP BY 1 HAVING count(*) = 1),
r AS (SELECT coalesce(tier, '(none)') AS tier, coalesce(morph_class, '(none)') AS morph_class, predicted = 'applicant' AS p, gold = 'applicant' AS g, predicted = 'ABSTAIN' AS a FROM g JOIN t USING (cue_id)),
k AS (SELECT coalesce(tier, '(all)') AS tier, coalesce(morph_class, '(all)') AS morph_class, count(*) AS n, count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (NOT p AND g) AS fn, avg(a::INT) AS ab FROM r GROUP BY CUBE (tier, morph_class))
SELECT tier, morph_class, n, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall,
CASE WHEN tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) END AS f1, round(ab, 6) AS abstention_rate FROM k""")
def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    """The classifier's referents against those of the table, by tier and gender."""
    mine = _classified(spark, d).select("cue_id", "tier", F.col("referent").alias("predicted")).distinct()
    gold = table(spark, d, "tagged_cues").select("cue_id", "referent", "gen").distinct().groupBy("cue_id").agg(F.count("*").alias("n"), F.first("referent").alias("gold"), F.first("gen").alias("morph_class")).where("n = 1").drop("n")
    out = prevalence.accuracy(mine.join(gold, "cue_id"))
    for c in ("precision", "recall", "f1", "abstention_rate"):
        out = out.withColumn(c, r6(c))
    return out


@query("""WITH r AS (SELECT c_mktsegment AS g, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 10 AS s FROM customer),
a AS (SELECT g, count(*) AS n, count(*) FILTER (s) AS k FROM r GROUP BY 1), b AS (SELECT *, k / n AS rate FROM a)
SELECT g AS "group", n, k AS n_chosen, round(rate, 6) AS selection_rate, round(rate / max(rate) OVER (), 6) AS impact_ratio, rate / max(rate) OVER () < 0.8 AS below_four_fifths FROM b""")
def selection_rate_air(spark: SparkSession, d: str) -> DataFrame:
    """Customers stand for applicants, nations for pools, segments for groups."""
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("pool_id"), F.col("c_mktsegment").alias("group"), F.col("c_acctbal").alias("score"), F.col("c_custkey").alias("id"))
    out = prevalence.selection_rates(rows, 10)
    return out.withColumn("selection_rate", r6("selection_rate")).withColumn("impact_ratio", r6("impact_ratio")).withColumn("n_chosen", F.col("n_chosen").cast("bigint"))


@query("""WITH s AS (SELECT l_suppkey % 50 AS pool_id, l_partkey % 400 AS pair_id, l_linestatus AS side, (l_partkey % 3)::VARCHAR AS "group", sum(l_quantity) AS score FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY score DESC, pair_id, "group", side) AS r FROM s),
d AS (SELECT "group", max(r) FILTER (side = 'F') - max(r) FILTER (side = 'O') AS d FROM r GROUP BY pool_id, pair_id, "group" HAVING count(DISTINCT side) = 2)
SELECT "group", count(*) AS n_pairs, round(avg(d), 6) AS mean, quantile_cont(d, 0.25) AS lower, quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.75) AS upper FROM d GROUP BY 1""")
def rank_displacement(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers stand for pools, parts for pairs, line status for the twins' sides."""
    rows = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("pool_id"), (F.col("l_partkey") % 400).alias("pair"), F.col("l_linestatus").alias("s"), (F.col("l_partkey") % 3).cast("string").alias("group")).agg(F.sum(F.col("l_quantity").cast("decimal(20,4)")).alias("score"))
    rows = rows.select("pool_id", F.struct("pair", "group").alias("pair_id"), F.when(F.col("s") == "F", "f").otherwise("m").alias("side"), "group", "score")
    return prevalence.rank_displacement(rows).withColumn("mean", r6("mean"))


@query("""WITH m AS (SELECT s_suppkey AS target_id, c_custkey AS candidate_id, row_number() OVER (PARTITION BY s_suppkey ORDER BY sha256('9|' || s_suppkey || '|' || c_custkey), c_custkey) AS place
  FROM supplier JOIN customer ON abs(s_acctbal - c_acctbal) <= 40) SELECT * FROM m WHERE place <= 5""")
def matched_pools(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers stand for twins, customers for competitors, balances for score sds."""
    targets = table(spark, d, "supplier").select(F.col("s_suppkey").alias("target_id"), F.col("s_acctbal").alias("sd"))
    rivals = table(spark, d, "customer").select(F.col("c_custkey").alias("candidate_id"), F.col("c_acctbal").alias("sd"))
    return prevalence.matched_pools(targets, rivals, 40.0, 5, 9)


@query("""WITH d AS (SELECT DISTINCT doc_id, CASE doc_type WHEN 'ad' THEN 'R1' ELSE 'R3' END AS register FROM doc_records),
n AS (SELECT doc_id, count(*) FILTER (referent = 'applicant' AND gen = 'm') AS m, count(*) FILTER (referent = 'applicant') AS a FROM tagged_cues GROUP BY 1)
SELECT doc_id, register FROM d LEFT JOIN n USING (doc_id) WHERE CASE register WHEN 'R1' THEN coalesce(m, 0) = 0 ELSE coalesce(a, 0) > 0 END""")
def register_violations(spark: SparkSession, d: str) -> DataFrame:
    """Ads are held to the generic masculine, CVs to freedom from agreement."""
    docs = table(spark, d, "doc_records").select("doc_id", F.when(F.col("doc_type") == "ad", "R1").otherwise("R3").alias("register"))
    return prevalence.register_violations(docs, table(spark, d, "tagged_cues"))


_TWO = r"list_filter(regexp_split_to_array({0}, '[\s\x0b\x1c-\x1f\x{{85}}\pZ]+'), lambda w: w <> '')"


@query(f"""WITH p AS (SELECT record_seq // 2 AS pair_id, max(text_norm) FILTER (record_seq % 2 = 0) AS f, max(text_norm) FILTER (record_seq % 2 = 1) AS m FROM doc_records WHERE text_norm IS NOT NULL GROUP BY 1 HAVING count(*) = 2),
w AS (SELECT *, {_TWO.format("f")} AS a, {_TWO.format("m")} AS b FROM p)
SELECT pair_id, len(a) = len(b) AS same_word_count, (length(f) - length(m))::INT AS length_delta, abs(length(f) - length(m)) <= 20 AS within_tolerance,
len(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x))))::INT AS n_only_f, len(list_distinct(list_filter(b, lambda x: NOT list_contains(a, x))))::INT AS n_only_m FROM w""")
def twin_differences(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring records stand for twins."""
    seq = F.col("record_seq")
    rows = table(spark, d, "doc_records").where("text_norm IS NOT NULL").groupBy(F.floor(seq / 2).alias("pair_id")).agg(
        F.count("*").alias("n"), F.max(F.when(seq % 2 == 0, F.col("text_norm"))).alias("text_f"), F.max(F.when(seq % 2 == 1, F.col("text_norm"))).alias("text_m")
    )
    out = prevalence.twin_differences(rows.where("n = 2"), 20)
    return out.select("pair_id", "same_word_count", "length_delta", "within_tolerance", F.size("only_f").alias("n_only_f"), F.size("only_m").alias("n_only_m"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS variance FROM lineitem GROUP BY 1, 2")
def cell_variances(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("score", F.col("l_quantity"))
    out = prevalence.cell_variance(rows, ["l_returnflag", "l_linestatus"])
    return out.withColumn("mean", r6("mean")).withColumn("variance", r6("variance"))


@query(f"SELECT s_suppkey AS id, round({_PHI.format(x='(s_suppkey % 121 - 60) / 10.0')}, 6) AS phi FROM supplier")
def normal_cdf(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), r6(stats.normal_cdf((F.col("s_suppkey") % 121 - 60) / 10)).alias("phi"))


@query(_KAPPA + "SELECT *, CASE WHEN kappa IS NULL THEN 'undefined' WHEN kappa < 0.7 THEN 'below_floor' ELSE 'usable' END AS gate_status FROM g")
def streaming_kappa(spark: SparkSession, d: str) -> DataFrame:
    """Kappas kept up to date over the log read as a stream, run until it is read up."""
    from tamarisk.streaming import annotations

    source = table(spark, d, "annotation_responses").select("seq", "item_id", "annotator_id", "answer", F.col("answered_at").alias("timestamp"), "comment")
    log, out, marks = (scratch_path(spark, f"kappa-{x}") for x in ("log", "out", "marks"))
    source.write.json(log)
    annotations.start_kappa(annotations.read(spark, log), out, marks).awaitTermination()
    k = annotations.kappas(spark, out)
    return k.select("annotator_a", "annotator_b", "n_items", *[r6(c).alias(c) for c in ("po", "pe", "kappa", "unclear_rate")], "undefined_reason", "gate_status")


# --- sources: the tables written as the files that are read -------------------------------

_TEXT = r"regexp_replace(regexp_replace(text_raw, '\r\n?', chr(10), 'g'), '^[\s\x0b\x1c-\x1f\x{85}\pZ]+|[\s\x0b\x1c-\x1f\x{85}\pZ]+$', '', 'g')"
_NAMES = {"EG": "Egypt", "JO": "Jordan", "SA": "Saudi Arabia", "AE": "UAE"}


def _csv(spark: SparkSession, d: str) -> str:
    """doc_records as the corpus's CSV; countries by turns, as the table's are dirty."""
    names = F.array(*map(F.lit, _NAMES.values()))
    rows = table(spark, d, "doc_records").select(
        F.regexp_replace("text_raw", r"\r\n?", "\n").alias("description"),
        F.get(names, (F.col("record_seq") % 4).cast("int")).alias("country"),
        F.coalesce("occupation", F.lit("")).alias("profession"),
        F.when(F.col("record_seq") % 3 == 0, " male ").when(F.col("record_seq") % 3 == 1, "female").otherwise("").alias("gender"),
    )
    path = scratch_path(spark, "corpus")
    rows.write.csv(path, header=True, quoteAll=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


@query(f"""WITH r AS (SELECT {_TEXT} AS t, ['EG', 'JO', 'SA', 'AE'][record_seq % 4 + 1] AS country, coalesce(occupation, '') AS o FROM doc_records)
SELECT substr(sha256(t), 1, 16) AS doc_id, 'ad' AS doc_type, sha256(nfc_normalize(t)) AS norm_hash, country, regexp_replace(o, '^\\s+|\\s+$', '', 'g') AS occupation, 'unspecified' AS seniority, sha256(t) AS source_checksum, count(*) AS n
FROM r WHERE t <> '' GROUP BY ALL""")
def corpus_load(spark: SparkSession, d: str) -> DataFrame:
    """Records of a CSV scan; equal ones counted."""
    docs = corpus.load(spark, _csv(spark, d))
    return docs.groupBy("doc_id", "doc_type", F.sha2("text_norm", 256).alias("norm_hash"), "country", "occupation", "seniority", "source_checksum").agg(F.count("*").alias("n"))


@query(f"""WITH r AS (SELECT {_TEXT} AS t, record_seq % 3 AS g FROM doc_records)
SELECT ['male', 'female', 'unknown'][g + 1] AS label, count(*) AS n FROM r WHERE t <> '' GROUP BY 1""")
def corpus_labels(spark: SparkSession, d: str) -> DataFrame:
    return corpus.label_counts(corpus.scan(spark, _csv(spark, d)))


@query(_ANSWERS + "SELECT count(*) AS n_rows, count(DISTINCT item_id) AS n_items, count(DISTINCT annotator_id) AS n_annotators, sum(seq)::BIGINT AS seqs, count(*) FILTER (answer = 'unclear') AS n_unclear FROM v WHERE annotator_id <> '' AND item_id IS NOT NULL")
def log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The valid answers appended to a log in two batches and read back."""
    log = AnnotationLog(spark, scratch_path(spark, "log"))
    rows = _answers(spark, d).select("seq", "item_id", "annotator_id", "answer", F.lit(None).cast("string").alias("timestamp"), F.lit(None).cast("string").alias("comment"))
    for half in (0, 1):
        log.append(rows.where(F.pmod(F.hash("item_id"), F.lit(2)) == half))
    return log.responses().agg(F.count("*").alias("n_rows"), F.count_distinct("item_id").alias("n_items"), F.count_distinct("annotator_id").alias("n_annotators"), F.sum("seq").alias("seqs"), F.count_if(F.col("answer") == "unclear").alias("n_unclear"))


# --- what the sections above leave open ------------------------------------------------------


@query("""SELECT DISTINCT i.item_id, c.cue_id FROM (SELECT DISTINCT substr(sha256('item:' || cue_id), 1, 12) AS item_id FROM tagged_cues JOIN doc_records USING (doc_id)) i
JOIN (SELECT DISTINCT cue_id, substr(sha256('item:' || cue_id), 1, 12) AS item_id FROM tagged_cues) c USING (item_id)""")
def manifest_rejoin(spark: SparkSession, d: str) -> DataFrame:
    """Blinded items led back to their cues by the restricted manifest."""
    opaque = F.substring(F.sha2(F.concat(F.lit("item:"), "cue_id"), 256), 1, 12)
    return annotation.unblinded(blind_items(spark, d).select("item_id").distinct(), annotation.sampling_manifest(table(spark, d, "tagged_cues"), opaque))


@query("SELECT DISTINCT cue_id, list_filter(['r', 'i', 'n'], lambda x: list_contains(rat_candidates, x)) AS candidates FROM tagged_cues WHERE rat_candidates IS NOT NULL")
def candidate_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tagged_cues").where("rat_candidates IS NOT NULL")
    return rows.select("cue_id", cues.canonical_set(F.col("rat_candidates")).alias("candidates")).distinct()


@query("""SELECT * FROM (VALUES ('config', sha256('{theta_high=0.75,theta_low=0.3}'), sha256('{theta_high=0.7,theta_low=0.3}')), ('source:code.txt', NULL, sha256('contents of code.txt')),
('source:more.txt', sha256('contents of more.txt'), NULL)) t(name, current, frozen)""")
def freeze_drift(spark: SparkSession, d: str) -> DataFrame:
    """A changed setting, a source that is gone and one that is new."""
    now = freeze.Manifest(("plan.txt", "more.txt"), "lock.txt", {"theta_high": 0.75, "theta_low": 0.3}, {"ads": "00ff"}, {"model": "1.5.2"})
    return freeze.drift(freeze.components(spark, now, lambda path: f"contents of {path}".encode()), _frozen(spark))


@query(f"""SELECT * FROM (VALUES ('same hash', true), ('other hash', false), ('anchor', true), ('anchor without reference', false), ('no anchor', false)) t(check_name, passes)""")
def freeze_checks(spark: SparkSession, d: str) -> DataFrame:
    """Which checks of a freeze pass and which raise."""
    parts = _frozen(spark)
    checks = {
        "same hash": lambda: freeze.verify(parts, freeze.freeze_hash(parts).first()[0]),
        "other hash": lambda: freeze.verify(parts, "0" * 64),
        "anchor": lambda: freeze.require_anchor({"service": "a time stamp service", "reference": "17"}),
        "anchor without reference": lambda: freeze.require_anchor({"service": "a time stamp service"}),
        "no anchor": lambda: freeze.require_anchor(None),
    }
    rows = []
    for name, check in checks.items():
        try:
            check()
            rows.append((name, True))
        except freeze.FreezeMismatch:
            rows.append((name, False))
    return spark.createDataFrame(rows, "check_name string, passes boolean")


@query(_TWINS + """, r AS (SELECT n.doc_id AS pair_id, nf, count(a.kind) AS k FROM n LEFT JOIN a ON a.pair_id = n.doc_id GROUP BY ALL)
SELECT pair_id, CASE WHEN k = 0 THEN pair_id || ': symmetric (' || nf || ' cues)' ELSE pair_id || ': ASYMMETRIC (' || k || ' differences)' END AS text FROM r""")
def twin_texts(spark: SparkSession, d: str) -> DataFrame:
    return twins.describe(twins.report(_twins(spark, d)))


@query(f"""WITH a AS ({ORACLES["holm"]}) SELECT family, family || ': ' || count(*) FILTER (reject) || ' of ' || count(*) || ' tests rejected after Holm''s correction' AS summary FROM a GROUP BY 1""")
def holm_summaries(spark: SparkSession, d: str) -> DataFrame:
    return inference.holm_summary(inference.holm(_p_values(spark, d)))


_CELL_SQL = f"""SELECT label, p, CASE WHEN p < 0.5 THEN 'inconclusive' WHEN eq THEN 'equivalent-within-margin' WHEN sig THEN 'difference-detected' ELSE 'inconclusive' END AS verdict,
CASE WHEN p < 0.5 THEN 'achieved power is below the floor' WHEN eq THEN 'both one-sided tests reject' WHEN sig THEN 'the interval excludes zero' ELSE 'neither a difference nor equivalence was shown' END AS reason
FROM (SELECT id::VARCHAR AS label, (id % 101) / 100.0 AS p, id % 3 = 0 AS eq, id % 2 = 0 AS sig FROM ({_TESTS}))"""


@query(f"""WITH v AS ({_CELL_SQL}), i AS ({ORACLES["interval_text"]})
SELECT '# Results' || chr(10) || chr(10) || '## Intervals' || chr(10) || '- **all**: ' || (SELECT text FROM i) || chr(10) || chr(10) || '## Cell verdicts' || chr(10) ||
(SELECT string_agg('- **' || label || '**: ' || verdict || ' (power ' || printf('%.3f', p::DOUBLE) || ' vs floor 0.500): ' || reason, chr(10) ORDER BY label) FROM v) || chr(10) || chr(10) ||
'## Abstentions' || chr(10) || chr(10) || 'Abstention rate: 0.1250. Abstained cues are a category of their own.' || chr(10) AS report""")
def report_text(spark: SparkSession, d: str) -> DataFrame:
    """The whole report of an interval and all cells, as one text."""
    k = F.col("id")
    cells = _tests(spark, d).select(k.cast("string").alias("label"), (k % 101 / 100).alias("achieved_power"), F.lit(0.5).alias("power_floor"), (k % 3 == 0).alias("equivalent"), (k % 2 == 0).alias("significant"))
    intervals = variance.cluster_robust(_differences(spark, d)).select(F.lit("all").alias("label"), reporting.interval_text().alias("text"))
    return spark.createDataFrame([(reporting.render(intervals, reporting.verdicts(cells), 0.125),)], "report string")


@query("""WITH c AS (SELECT cue_id, min(token) AS token, min(head_token) AS head, min(referent) AS referent FROM tagged_cues WHERE cue_id IS NOT NULL GROUP BY 1),
h AS (SELECT token AS target_id, CASE WHEN count(DISTINCT referent) = 1 THEN min(referent) ELSE 'ABSTAIN' END AS head_referent FROM c WHERE token IS NOT NULL GROUP BY 1)
SELECT cue_id, head AS target_id, CASE WHEN head IS NULL OR coalesce(head_referent, 'ABSTAIN') = 'ABSTAIN' THEN 'ABSTAIN' ELSE head_referent END AS referent,
CASE WHEN head IS NULL THEN 'AB2' WHEN coalesce(head_referent, 'ABSTAIN') = 'ABSTAIN' THEN 'AB3' END AS abstain_reason FROM c LEFT JOIN h ON h.target_id = c.head""")
def inherited_referents(spark: SparkSession, d: str) -> DataFrame:
    """Cues with the referent of their head token; a token whose cues disagree abstains."""
    c = table(spark, d, "tagged_cues").where("cue_id IS NOT NULL").groupBy("cue_id").agg(F.min("token").alias("token"), F.min("head_token").alias("target_id"), F.min("referent").alias("referent"))
    heads = c.where("token IS NOT NULL").groupBy(F.col("token").alias("target_id")).agg(F.count_distinct("referent").alias("k"), F.min("referent").alias("r"))
    heads = heads.select("target_id", F.when(F.col("k") == 1, F.col("r")).otherwise("ABSTAIN").alias("referent"))
    return prevalence.inherited(c.select("cue_id"), c.select("cue_id", "target_id"), heads)


@query("""WITH c AS (SELECT coalesce(pos, '(none)') AS pos, coalesce(tier, '(none)') AS tier, coalesce(referent, '(none)') AS referent FROM tagged_cues),
e AS (SELECT 'pos' AS dimension, pos AS value, referent FROM c UNION ALL SELECT 'tier', tier, referent FROM c)
SELECT dimension, value, referent, count(*) AS n_cues, round(count(*) / sum(count(*)) OVER (PARTITION BY dimension, value), 6) AS share FROM e GROUP BY 1, 2, 3""")
def cue_distribution(spark: SparkSession, d: str) -> DataFrame:
    return prevalence.distribution(table(spark, d, "tagged_cues")).withColumn("share", r6("share"))


@query("""SELECT ad, pair, round(f - m, 6) AS difference FROM (SELECT 's' || s_suppkey AS ad, 'n' || s_nationkey AS pair, s_acctbal AS f, s_suppkey % 100 AS m FROM supplier)""")
def score_differences(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("ad"), F.concat(F.lit("n"), "s_nationkey").alias("pair"), F.col("s_acctbal").alias("score_f"), (F.col("s_suppkey") % 100).alias("score_m"))
    return s.select("ad", "pair", F.round(scoring.difference(), 6).alias("difference"))

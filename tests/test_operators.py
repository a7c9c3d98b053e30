import hashlib
import hmac
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tamarisk.functions import text
from tamarisk.operators import annotation, blinding, freeze, prevalence, sampling, target, twins, validate


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_nfc_keeps_letters_and_composes(spark):
    given = ["حاصلة على بكالوريوس هندسة", "أحمد إبراهيم آدم", "مُهَنْدِسَة", "plain", "", None, "é", "أ"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(given)], "k int, t string")
    got = {r.k: r.n for r in text.nfc(df, "t", "n").collect()}
    assert got == {k: t if t is None else unicodedata.normalize("NFC", t) for k, t in enumerate(given)}
    ok = text.nfc(df, "t", "n").where("n IS NOT NULL").where(~text.protected_unchanged(F.col("n"), F.col("n")))
    assert ok.count() == 0
    folded = spark.createDataFrame([("مهندسة", "مهندسه")], "a string, b string")
    assert folded.where(text.protected_unchanged(F.col("a"), F.col("b"))).count() == 0


def test_words_and_strip_follow_python(spark):
    given = ["a b c d\x1ce", " 　x ", "", "\t\n", "one"]
    df = spark.createDataFrame([(t,) for t in given], "t string")
    for r in df.select("t", text.word_count(F.col("t")).alias("n"), text.strip(F.col("t")).alias("s")).collect():
        assert (r.n, r.s) == (len(r.t.split()), r.t.strip())


def test_spans_walk_forward(spark):
    def brute(t, tokens):
        at, out = 0, []
        for w in tokens:
            k = t.find(w, at)
            k = at if k < 0 else k
            at = k + len(w)
            out.append((k, at))
        return out

    cases = [("خبرة في خبرة", ["خبرة", "في", "خبرة"]), ("a b", ["x", "b"]), ("", ["a"]), ("abc", [])]
    df = spark.createDataFrame(cases, "t string, w array<string>")
    for r in df.select("t", "w", text.spans(F.col("t"), F.col("w")).alias("s")).collect():
        assert [tuple(x) for x in r.s] == brute(r.t, r.w)


def test_tokens_equal_hmac(spark):
    key = b"sixteen bytes at least"
    df = spark.createDataFrame([("R1", "f", "7")], "a string, b string, c string")
    cell = blinding.canonical(F.col("a"), F.col("b"), F.col("c"))
    want = hmac.new(key, b"register=R1|polarity=f|pair=7", hashlib.sha256).hexdigest()[:32]
    got = df.select(blinding.token(cell, key).alias("x"), blinding.token(cell, key, in_plan=True).alias("y")).first()
    assert (got.x, got.y) == (want, want)
    for bad in (b"", b"short"):
        with pytest.raises(blinding.BlindingError):
            blinding.token(cell, bad)


@pytest.mark.parametrize(
    "values, leaks",
    [("ffmm", True), ("fmfm", True), ("ffff", False), ("fmmfmf", False), ("aabbcc", True), ("abcabc", False), ("fm", True), ("", False)],
)
def test_ordering_leak(spark, values, leaks):
    df = spark.createDataFrame([(k + 1, v) for k, v in enumerate(values)], "position int, v string")
    assert blinding.ordering_leak(df, "v").first().leaks is leaks


def tokens(spark, *seq):
    return spark.createDataFrame([(1, k, p, g) for k, (p, g) in enumerate(seq)], "sentence_id int, index int, pos string, gen string")


@pytest.mark.parametrize(
    "seq, outcome, head",
    [
        ([("adj", "m"), ("noun", "m"), ("noun", "f"), ("prep", None), ("noun", "f"), ("adj", "f")], "target", 4),
        ([("noun", "f"), ("noun", "m"), ("noun", "f"), ("adj", "f")], "target", 2),
        ([("noun", "f"), ("adj", "f")], "target", 0),
        ([("noun", "f"), ("noun", "f"), ("adj", "f")], "two_compete", None),
        ([("noun", "f"), ("adj", "f"), ("conj", None), ("adj", "f")], "target", 0),
        ([("noun", "f"), ("noun", "m"), ("adj", "f")], "disagrees", None),
        ([("adj", "f")], "initial", None),
        ([("noun", "f"), ("prep", None), ("adj", "f")], "blocked", None),
        ([("conj", None), ("adj", "f")], "none", None),
        ([("noun", "na"), ("adj", "na")], "disagrees", None),
        ([(None, None), ("adj", "f")], "blocked", None),
    ],
)
def test_agreement_targets(spark, seq, outcome, head):
    last = target.agreement_targets(tokens(spark, *seq)).orderBy(F.desc("index")).first()
    assert (last.outcome, last.target_index) == (outcome, head)
    assert last.abstain_reason == (None if outcome == "target" else "AB2")


def test_agreement_targets_refuse_verbs(spark):
    df = tokens(spark, ("noun", "f"), ("verb", "f")).withColumn("is_cue", F.col("pos") == "verb")
    with pytest.raises(Exception, match="no adjective"):
        target.agreement_targets(df, strict=True).collect()


def test_twins(spark):
    schema = "pair_id string, side string, token_index int, tier string, referent string, abstain_reason string, gen string"
    data = [
        ("p", "f", 0, "A", "applicant", None, "f"), ("p", "m", 0, "A", "applicant", None, "m"),
        ("q", "f", 0, "A", "ABSTAIN", "AB4", "f"), ("q", "m", 3, "B", "ABSTAIN", "AB1", "m"), ("q", "f", 9, "A", "applicant", None, "f"),
        ("r", "f", 0, "A", "applicant", None, "m"), ("r", "m", 0, "A", "applicant", None, "m"),
    ]
    df = spark.createDataFrame(data, schema)
    found = {(r.pair_id, r.kind, r.position) for r in twins.asymmetries(df, compare_index=True).collect()}
    assert found == {("q", "tier", 0), ("q", "abstain_trigger", 0), ("q", "token_index", 0), ("q", "cue_count", None)}
    assert {r.pair_id: r.symmetric for r in twins.report(df).collect()} == {"p": True, "q": False, "r": True}
    assert {r.pair_id: r.genders_differ for r in twins.genders_differ(df).collect()} == {"p": True, "q": True, "r": False}
    assert twins.describe(twins.report(df)).where("text LIKE '%ASYMMETRIC%'").count() == 1


def log(spark, *data):
    return spark.createDataFrame([(k, *x) for k, x in enumerate(data)], "seq bigint, item_id string, annotator_id string, answer string")


def kappa(spark, a, b):
    data = [(f"i{k}", who, x) for who, answers in (("A", a), ("B", b)) for k, x in enumerate(answers)]
    return annotation.kappa_pairs(annotation.answers(log(spark, *data)))


APP, NON, UNC = annotation.LABELS


def test_kappa_goldens(spark):
    same = kappa(spark, [APP, NON, UNC], [APP, NON, UNC]).first()
    assert same.kappa == pytest.approx(1)
    half = kappa(spark, [APP, UNC, UNC], [APP, UNC, NON]).first()
    assert (half.n_items, half.po, half.pe, half.kappa) == (3, pytest.approx(2 / 3), pytest.approx(1 / 3), pytest.approx(0.5))
    one = kappa(spark, [APP, APP], [APP, APP])
    assert one.first().kappa is None and one.first().undefined_reason
    bad = kappa(spark, [APP, NON, APP, UNC], [NON, APP, UNC, APP])
    assert bad.first().kappa == pytest.approx(-0.6)
    for k in (one, bad):
        with pytest.raises(annotation.GoldSetUnusable):
            annotation.assert_usable(k)
    annotation.assert_usable(kappa(spark, [APP, NON, UNC], [APP, NON, UNC]))


def test_log_operations(spark):
    df = annotation.answers(log(spark, ("i1", "A1", APP), ("i1", "A2", " NON-applicant "), ("i2", "A1", "skip"), ("i1", "A1", UNC), ("i3", "A1", None), ("i2", "A1", "Unclear")), strict=False)
    assert rows(annotation.last_answers(df).drop("seq")) == [("A1", "i1", UNC), ("A1", "i2", UNC), ("A2", "i1", NON)]
    assert [r.item_id for r in annotation.double_annotated(df).collect()] == ["i1"]
    assert annotation.unclear_rate(df).first()[0] == 0.5
    assert annotation.unclear_rate(df.where("false")).first()[0] == 0.0
    items = spark.createDataFrame([("i1",), ("i9",)], "item_id string")
    assert [r.item_id for r in annotation.todo(items, df, "A2").collect()] == ["i9"]
    with pytest.raises(Exception, match="no label"):
        annotation.answers(log(spark, ("i", "A", "maybe"))).collect()


def test_adjudication(spark):
    df = spark.createDataFrame([(APP, APP, None, APP), (APP, NON, NON, NON), (APP, NON, UNC, UNC)], "a string, b string, c string, want string")
    got = df.withColumn("got", annotation.adjudicate(F.col("a"), F.col("b"), F.col("c")))
    assert got.where("got <> want").count() == 0
    with pytest.raises(Exception, match="third"):
        spark.createDataFrame([(APP, NON, None)], "a string, b string, c string").select(annotation.adjudicate(F.col("a"), F.col("b"), F.col("c"))).collect()
    with pytest.raises(ValueError):
        annotation.assert_item_schema(df)


def cue_table(spark, n=400, shuffle=None):
    rng = random.Random(3)
    data = [(f"c{k:04d}", rng.choice(["x", "y", "hot"]) if k % 9 else "hot", rng.choice(["EG", "JO", None])) for k in range(n)]
    if shuffle:
        random.Random(shuffle).shuffle(data)
    return spark.createDataFrame(data, "cue_id string, token string, country string")


def test_sampling_is_stable_and_reports(spark):
    a = rows(sampling.draw(cue_table(spark), ["country"], 60, 1, {"hot": 3.0}))
    b = rows(sampling.draw(cue_table(spark, shuffle=5).repartition(7), ["country"], 60, 1, {"hot": 3.0}))
    c = rows(sampling.draw(cue_table(spark), ["country"], 60, 2, {"hot": 3.0}))
    assert a == b and a != c and len(a) == 60
    base = cue_table(spark).where("token = 'hot'").count() / 400
    assert sum(s.endswith("|hot") for _, s in a) / 60 > 1.5 * base
    few = sampling.quotas(cue_table(spark, 2), ["country"], 50, {})
    assert sampling.shortfalls(few).count() > 0 and few.agg(F.sum("quota")).first()[0] == 50
    with pytest.raises(ValueError):
        sampling.quotas(cue_table(spark), ["country"], 0, {})


def test_sampling_buckets_agree_with_a_plain_sort(spark, monkeypatch):
    a = rows(sampling.draw(cue_table(spark), ["country"], 90, 1, {}))
    monkeypatch.setattr(sampling, "BUCKET_ROWS", 7)
    assert rows(sampling.draw(cue_table(spark), ["country"], 90, 1, {})) == a


def test_freeze(spark):
    m = freeze.Manifest(("a", "b"), "lock", {"y": [1, None, True], "x": {"k": "v"}})
    parts = freeze.components(spark, m, lambda p: p.encode())
    digests = {r.name: r.digest for r in parts.collect()}
    assert digests["config"] == hashlib.sha256(b"{x={k=v},y=[1,null,true]}").hexdigest()
    lines = "\n".join(f"{k}={digests[k]}" for k in sorted(digests))
    want = hashlib.sha256(lines.encode()).hexdigest()
    freeze.verify(parts, want)
    other = freeze.components(spark, m, lambda p: (p + "!").encode())
    with pytest.raises(freeze.FreezeMismatch):
        freeze.verify(other, want)
    assert {r.name for r in freeze.drift(other, parts).collect()} == {"source:a", "source:b", "lockfile:lock"}
    for bad in ((), ("a", "a")):
        with pytest.raises(ValueError):
            freeze.Manifest(bad, "lock")
    for anchor in (None, {}, {"service": "x"}):
        with pytest.raises(freeze.FreezeMismatch):
            freeze.require_anchor(anchor)
    freeze.require_anchor({"service": "x", "reference": "y"})


def test_validation(spark):
    df = spark.createDataFrame([("a", "A", "ABSTAIN", None, None), ("b", "A", "applicant", "AB1", "h"), ("c", "C", "applicant", None, "h"), ("d", "Z", None, None, None)], "k string, tier string, referent string, abstain_reason string, head_token string")
    got = rows(validate.violations(df, "k"))
    assert [k for k, _ in got] == ["a", "b", "b", "d"]
    with pytest.raises(ValueError):
        validate.assert_valid(df, "k")
    validate.assert_valid(df.where("k = 'c'"), "k")


def test_inheritance(spark):
    cues = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "cue_id string")
    targets = spark.createDataFrame([("c1", "t1"), ("c2", "t2")], "cue_id string, target_id string")
    heads = spark.createDataFrame([("t1", "applicant"), ("t2", "ABSTAIN")], "target_id string, referent string")
    got = {r.cue_id: (r.referent, r.abstain_reason) for r in prevalence.inherited(cues, targets, heads).collect()}
    assert got == {"c1": ("applicant", None), "c2": ("ABSTAIN", "AB3"), "c3": ("ABSTAIN", "AB2")}


def test_pools_against_brute_force(spark):
    rng = random.Random(8)
    t = [(k, rng.uniform(-5, 5)) for k in range(12)] + [(99, None)]
    c = [(k, rng.uniform(-5, 5)) for k in range(300)] + [(999, None)]
    got = prevalence.matched_pools(spark.createDataFrame(t, "target_id int, sd double"), spark.createDataFrame(c, "candidate_id int, sd double"), 0.7, 4, 3)
    pools = {}
    for r in got.collect():
        pools.setdefault(r.target_id, []).append(r.candidate_id)
    for k, sd in t[:-1]:
        near = sorted((hashlib.sha256(f"3|{k}|{i}".encode()).hexdigest(), i) for i, x in c[:-1] if abs(x - sd) <= 0.7)
        assert sorted(pools.get(k, [])) == sorted(i for _, i in near[:4])
    with pytest.raises(ValueError):
        prevalence.matched_pools(got, got, 0.0, 4, 3)


def _pools(spark, t, c, *args):
    got = prevalence.matched_pools(spark.createDataFrame(t, "target_id int, sd double"), spark.createDataFrame(c, "candidate_id int, sd double"), *args)
    pools = {}
    for r in sorted(got.collect(), key=lambda r: r.place):
        pools.setdefault(r.target_id, []).append(r.candidate_id)
    return pools


def test_pools_of_odd_sds(spark):
    inf, nan = float("inf"), float("nan")
    t = [(1, 40.0), (2, inf), (3, nan), (4, 1e30), (5, -inf), (6, -1e-20)]
    c = [(1, -1e-20), (2, inf), (3, nan), (4, 1e30), (5, -inf), (6, 40.0), (7, 80.0), (8, 80.00001)]
    assert {k: sorted(x) for k, x in _pools(spark, t, c, 40.0, 9, 3).items()} == {1: [1, 6, 7], 4: [4], 6: [1, 6]}


def test_pools_of_null_ids_like_sql(spark):
    t, c = [(1, 0.0), (None, 0.0), (2, 9.0)], [(k, 0.1) for k in (5, None, 3, 4)]
    by_hash = sorted((3, 4, 5), key=lambda i: hashlib.sha256(f"3|1|{i}".encode()).hexdigest())
    assert _pools(spark, t, c, 1.0, 9, 3) == {1: [*by_hash, None], None: [3, 4, 5, None]}


@pytest.mark.parametrize("spare", [20, -4, -7])
def test_pools_short_of_low_hashes_and_split_cells(spark, monkeypatch, spare):
    """With fewer hashes expected below the bound than the pool holds, targets sort all of their matches."""
    monkeypatch.setattr(prevalence, "TASK_PAIRS", 200)
    rng = random.Random(9)
    t = [(k, rng.choice([0.0, rng.uniform(-5, 5)])) for k in range(15)] + [(99, 50.0)]
    c = [(k, rng.choice([0.0, rng.uniform(-5, 5)])) for k in range(200)]
    want = {k: [i for _, i in sorted((hashlib.sha256(f"3|{k}|{i}".encode()).hexdigest(), i) for i, x in c if abs(x - sd) <= 0.7)[:4]] for k, sd in t}
    assert _pools(spark, t, c, 0.7, 4, 3, spare) == {k: x for k, x in want.items() if x}


def test_pools_sort_few_of_their_pairs(spark):
    """A million pairs of two small tables: no stage holds them all in memory, as a sort of them does with 170 MB."""
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {s.stageId(): s.peakExecutionMemory() for s in map(found.apply, range(found.size()))}

    before = stages()
    t = spark.range(50).select(F.col("id").alias("target_id"), (F.col("id") / 50).alias("sd"))
    c = spark.range(20_000).select(F.col("id").alias("candidate_id"), (F.col("id") / 20_000).alias("sd"))
    assert prevalence.matched_pools(t, c, 2.0, 5, 3).count() == 250
    peaks = [m for s, m in stages().items() if s not in before]
    assert peaks and max(peaks) < 120e6


def test_registers_and_twins(spark):
    docs = spark.createDataFrame([("a", "R1"), ("b", "R1"), ("c", "R2"), ("d", "R3"), ("e", "R5"), ("f", "R2")], "doc_id string, register string")
    cues = spark.createDataFrame([("a", "applicant", "m"), ("b", "applicant", "f"), ("c", "applicant", "m"), ("d", "applicant", "f"), ("e", "non_applicant", "f"), ("f", "applicant", "m"), ("f", "applicant", "f")], "doc_id string, referent string, gen string")
    assert sorted(r.doc_id for r in prevalence.register_violations(docs, cues).collect()) == ["b", "c", "d", "e"]
    sets = [("q", "R2", 1, "one two three"), ("r", "R4", 1, "uno dos tres"), ("s", "R4", 1, "too short"), ("t", "R4", 2, "one two three"), ("u", "R4", 1, "eins zwei drei"), ("v", "R4", 1, "a b c"), ("w", "R1", None, None)]
    docs = spark.createDataFrame(sets, "doc_id string, register string, set_id int, text_norm string")
    about = [(d, "applicant", "m") for d in "qrstuw"] + [("q", "applicant", "f"), ("u", "applicant", "f")]
    cues = spark.createDataFrame(about, "doc_id string, referent string, gen string")
    assert sorted(r.doc_id for r in prevalence.register_violations(docs, cues).collect()) == ["s", "t", "u", "v"]
    shares = {(r.dimension, r.value, r.referent): (r.n_cues, r.share) for r in prevalence.distribution(cues.withColumn("x", F.lit(None).cast("string")), ("gen", "x")).collect()}
    assert shares == {("gen", "m", "applicant"): (6, 1.0), ("gen", "f", "applicant"): (2, 1.0), ("x", "(none)", "applicant"): (8, 1.0)}
    pair = spark.createDataFrame([(1, "حاصلة على شهادة", "حاصل  على شهادة")], "pair_id int, text_f string, text_m string")
    r = prevalence.twin_differences(pair, 1).first()
    assert (r.same_word_count, r.length_delta, r.within_tolerance, r.only_f, r.only_m) == (True, 0, True, ["حاصلة"], ["حاصل"])


def test_manifest_leads_back(spark):
    cues = spark.createDataFrame([("c1",), ("c2",), ("c1",)], "cue_id string")
    manifest = annotation.sampling_manifest(cues, F.concat(F.lit("x"), "cue_id"))
    items = spark.createDataFrame([("xc2", "s"), ("xc9", "t")], "item_id string, sentence string")
    assert rows(annotation.unblinded(items, manifest)) == [("xc2", "s", "c2"), ("xc9", "t", None)]
    with pytest.raises(Exception, match="share the item id"):
        annotation.sampling_manifest(cues, F.lit("same")).collect()


def test_classified_rows_are_valid(spark):
    """What classify gives before targets are known breaks no rule."""
    from tamarisk.operators import validate

    df = spark.createDataFrame([("c", "C", "PENDING", None), ("d", "A", "maybe", None)], "cue_id string, tier string, referent string, abstain_reason string")
    assert rows(validate.violations(df, "cue_id")) == [("d", "referent is unknown")]


def test_hot_keys_are_split(spark, monkeypatch):
    from tamarisk import session

    left = spark.createDataFrame([("hot", k) for k in range(90)] + [("cold", 1), (None, 2), ("alone", 3)], "k string, v int")
    right = spark.createDataFrame([("hot", "a"), ("cold", "b"), ("other", "c")], "k string, w string")
    want = {how: rows(left.join(right, ["k"], how)) for how in ("inner", "left", "left_semi", "left_anti")}
    key = lambda t: sorted(t, key=repr)
    for limit in (session.BROADCAST_ROWS, 0):
        monkeypatch.setattr(session, "BROADCAST_ROWS", limit)
        for how, expected in want.items():
            assert key(rows(session.join_split(left, right, ["k"], F.col("v"), how, hot_rows=10))) == key(expected)


def test_common_cells_are_ordered_in_ranges(spark):
    """A cell that nearly all rows share is numbered by several tasks, without gaps or ties."""
    df = spark.range(400).select(F.when(F.col("id") < 390, "common").otherwise(F.col("id").cast("string")).alias("cell"), "id").repartition(5)
    out = blinding.blind_order(df, b"k" * 16, F.col("cell"), "id").collect()
    order = [(r.blind_token, r.id) for r in sorted(out, key=lambda r: r.position)]
    assert [r.position for r in sorted(out, key=lambda r: r.position)] == list(range(1, 401)) and order == sorted(order)

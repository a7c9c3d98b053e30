"""Encoding, packing, format-blind duplicates, sentences."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarisk.llm import bpe, formatdup, packing, sentences

tokenizers = pytest.importorskip("tokenizers")

TEXTS = ["", None, " ", "a", "Hello, world's best!", "aaaaaaaaaaa", "ab" * 3000, "<|endoftext|>", "\x00\x1c\x85 ‏", "مُهَنْدِسَة 12٣", "你好" * 400, "é ퟿\U0001f600", "  \n\n x  ", "x" * 50_001]


def reference():
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_encoding_equals_the_library(spark):
    t = reference()
    df = spark.createDataFrame([(k, x, "clash") for k, x in enumerate(TEXTS)], "doc_id int, text string, ids string").repartition(3)
    got = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    assert got == {k: t.encode(x or "", add_special_tokens=False).ids for k, x in enumerate(TEXTS)}
    assert bpe.encode(df.where("false")).count() == 0
    sizes = {r.doc_id: r.n_tokens for r in bpe.token_counts(df).collect()}
    assert sizes == {k: len(v) for k, v in got.items()}


def test_encoding_of_random_texts():
    rng = random.Random(4)
    t, own = reference(), bpe.load(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json")
    alphabet = "abcde 'st\n.,09المُ你กरा\U0001f600"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in own.encode_batch(texts)] == want and own.count_batch(texts) == list(map(len, want))


def test_packing_is_valid_and_tight():
    rng = np.random.default_rng(1)
    for capacity in (10, 256, 4096):
        for sizes in (rng.integers(1, capacity + 1, 500), rng.integers(1, max(2, capacity // 3), 500), np.full(50, capacity // 2 + 1), np.array([capacity])):
            where, settled = packing.pack(sizes, capacity)
            assert settled
            fill = np.bincount(where, sizes)
            assert fill.max() <= capacity and (np.unique(where) == np.arange(len(fill))).all()
            first, fills = packing.best_fit(sizes, capacity)
            assert len(fill) <= len(fills)


def test_local_search_improves_a_poor_start():
    sizes = np.array([6, 5, 5, 4, 4, 3, 3])  # 30 = 3 containers of 10
    poor = np.array([0, 1, 2, 2, 3, 3, 1])
    fills = np.bincount(poor, sizes).tolist()
    better, settled = packing.improve(sizes, poor, fills, 10)
    assert settled and not packing.improve(sizes, poor, fills, 10, passes=0)[1]
    got = np.bincount(better, sizes, minlength=4)
    assert got.max() <= 10 and np.count_nonzero(got) == 3 < np.count_nonzero(fills)


def test_pairs_among_very_many_documents():
    """A two-for-one exchange is found however many documents the giving container has."""
    many = [1] * 100 + [3, 4]  # the emptiest container; only 3 + 4 for the other's 6 fills it
    sizes = np.array([*many, 6, 994, 500, 493])
    where = np.array([0] * 102 + [1, 1, 2, 2])
    fill = np.bincount(where, sizes).astype(np.int64)
    mine, others = np.flatnonzero(where == 0), np.array([102])
    gives, takes, target = packing._step(sizes, where, fill - np.array([0, 0, 0]), mine, others, 1001)
    assert sizes[gives].sum() - sizes[takes].sum() == 1 and target == 1


def test_decoding_returns_the_bytes(spark):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(TEXTS)], "doc_id int, text string")
    got = {r.doc_id: bytes(r.bytes) for r in bpe.decode(bpe.encode(df)).collect()}
    assert got == {k: (x or "").encode() for k, x in enumerate(TEXTS)}


def test_vocabulary_is_shipped(spark, tmp_path):
    """A vocabulary that is missing at its path is read from the files sent to the workers."""
    import shutil

    from pyspark import SparkFiles

    shutil.copy(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json", tmp_path / "own.json")
    df = spark.createDataFrame([("one two",)], "text string")
    want = reference().encode("one two", add_special_tokens=False).ids
    assert bpe.encode(df, tokenizer="own", tokenizer_dir=str(tmp_path)).first().ids == want
    assert bpe.load(str(tmp_path / "elsewhere" / "own.json")).encode_batch(["one two"])[0].tolist() == want and SparkFiles.get("own.json")


def test_containers(spark):
    rng = random.Random(2)
    data = [(k, rng.randint(0, 700)) for k in range(400)] + [(3, 5), (3, 5), (900, None), (901, 0), (902, 256), (903, 5000), (None, 7)]
    sized = spark.createDataFrame(data, "doc_id bigint, n_tokens int").withColumn("capacity", F.lit("clash")).withColumn("piece", F.lit("clash"))
    profiles = spark.createDataFrame([(1, 256), (2, 4096), (3, 0), (4, None)], "profile_id int, capacity int")
    got = packing.containers(sized, profiles, shard_items=60).collect()
    for profile, capacity in ((1, 256), (2, 4096)):
        fill, tokens, pieces = defaultdict(int), defaultdict(int), defaultdict(list)
        for r in got:
            if r.profile_id == profile:
                fill[r.container_id] += r.n_tokens
                tokens[r.doc_id] += r.n_tokens
                pieces[r.doc_id].append(r.n_tokens)
        assert max(fill.values()) <= capacity
        want = defaultdict(int)
        for k, n in set(data):
            want[k] += n or 0
        assert tokens == want
        assert all(len(p) == 1 for k, p in pieces.items() if want[k] <= capacity and k != 3)
    assert {r.profile_id for r in got} == {1, 2} and len(got) == len(set(got))
    summary = {r.profile_id: r for r in packing.fills(packing.containers(sized, profiles), profiles).collect()}
    assert summary[1].fill > 0.98 and summary[1].fullest == 256
    assert packing.containers(sized.where("false"), profiles).count() == 0
    assert packing.containers(sized, profiles.where("false")).count() == 0


LIST = "Company: Hanlan Ltd.\nSalary: 5 EGP\nCity: Giza"
SAME = [LIST, "city:GIZA;  salary:5 egp; company:Hanlan Ltd", '{"Salary":"5 EGP", "Company":"Hanlan Ltd.", "City":"Giza"}', "* Salary= 5 EGP\r\n* City= Giza\r\n* Company= Hanlan Ltd.", "Company Hanlan Ltd Salary 5 EGP City Giza", "1. City: Giza\n2. Salary: 5 EGP\n3. Company: Hanlan Ltd."]
OTHER = ["Company: Giza\nSalary: 5 EGP\nCity: Hanlan Ltd.", "Company: Hanlan Ltd.\nSalary: 6 EGP\nCity: Giza", "City Giza Salary 5 EGP Company Hanlan Ltd"]
TEXT = ["Café (open)!", "café OPEN", "CAFÉ​\tOpen..."]
MARKS = ["مُهندس", "مهندس", "مهندسة", "مهندسه"]


NESTED = ['{"a": {"x": "1", "y": "2"}, "b": "3"}', "{ 'B' : 3, 'A' : { 'Y' : 2, 'X' : 1 } }", "b: 3\na: {y: 2, x: 1}"]
ARRAYS = ['{"jobs": [{"at": "Giza", "no": 1}, {"at": "Cairo", "no": 2}], "name": "N"}', '{"name": "n", "jobs": [{"no": 1, "at": "giza"}, {"no": 2, "at": "cairo"}]}', '{"jobs": [{"at": "Cairo", "no": 2}, {"at": "Giza", "no": 1}], "name": "N"}']
LONG = ["Years of relevant professional work experience: 5 / City: Cairo".replace(" / ", "\n"), "City: Cairo\nYears of relevant professional work experience: 5", f"{'long label ' * 40}: 1; b: 2", f"b: 2; {'LONG label ' * 40}= 1"]


def test_formatting_disappears(spark):
    texts = SAME + OTHER + TEXT + MARKS + ["", None, "...", "???", "x" * 300_000, "X" * 300_000 + "!"]
    df = spark.createDataFrame([(f"d{k:02d}", t, "clash", 1) for k, t in enumerate(texts)], "doc_id string, text_raw string, id string, n_rows int")
    df = df.union(df.limit(3)).repartition(5)
    got = {tuple(r) for r in formatdup.pairs(df).collect()}
    trees = {f"d{k:02d}": formatdup.tree(t, formatdup.Trees()) for k, t in enumerate(texts)}
    agree = lambda x, y: any(p is not None and p == q for p, q in zip(x, y))
    assert got == {(a, b) for a, b in itertools.combinations(sorted(trees), 2) if agree(trees[a], trees[b])}
    listed = [f"d{k:02d}" for k in (0, 1, 2, 3, 5)]
    assert set(itertools.combinations(listed, 2)) | {("d00", "d04"), ("d01", "d08")} <= got
    assert set(itertools.combinations(["d09", "d10", "d11"], 2)) <= got
    assert not {p for p in got if set(p) & {"d06", "d07", "d12", "d13", "d14", "d15", "d16", "d17", "d18", "d19"}}
    records = {r.record_id: (r.n_copies, r.n_rows) for r in formatdup.collapsed(df).collect()}
    assert records["d00"] == (7, 10) and sum(n for n, _ in records.values()) == len(texts)
    assert formatdup.pairs(df.where("false")).count() == formatdup.collapsed(df.where("false")).count() == 0


def test_lists_of_any_depth_and_label():
    for build in (formatdup.Digests(), formatdup.Trees()):
        as_list = lambda t: formatdup.tree(t, build)[1]
        assert as_list(NESTED[0]) and len({as_list(t) for t in NESTED}) == 1
        one, two, other = map(as_list, ARRAYS)
        assert one == two != other  # objects are unordered, arrays aren't
        assert as_list(LONG[0]) == as_list(LONG[1]) is not None and as_list(LONG[2]) == as_list(LONG[3]) is not None
        assert as_list('{"a": {"x": "1"}, "b": "3"}') != as_list('{"b": {"x": "1"}, "a": "3"}')
        assert as_list("{" + '"a": {' * 50_000 + '"b": "1", "c": "2"' + "}" * 50_001)  # no recursion
        for broken in ('{"a": 1, "b"', '{"a": {"x": 1}, "b": 2]', "{,}", '{"a": 1 "b": 2', "{" * 1000, "a: {b: 1\nc: 2}}\nd: 3"):
            formatdup.tree(broken, build)


def test_digests_need_full_agreement(spark):
    """With digests of one byte most records collide; whole trees tell them apart."""
    data = [(f"d{k:04d}", f"text {k // 2}" + "!" * (k % 2)) for k in range(1200)]
    data += [(f"e{k:04d}", f"a: {k // 2}\nb: 1" if k % 2 else f"b: 1\na: {k // 2}") for k in range(600)]
    df = spark.createDataFrame(data, "doc_id string, text_raw string")
    got = sorted(tuple(r) for r in formatdup.pairs(df, size=1).collect())
    assert got == [(f"{c}{k:04d}", f"{c}{k + 1:04d}") for c, n in (("d", 1200), ("e", 600)) for k in range(0, n, 2)]
    assert {r.n_copies for r in formatdup.collapsed(df, size=1).collect()} == {2}


def test_hot_groups_are_split(spark, monkeypatch):
    from tamarisk import session

    data = [(f"d{k:03d}", "Same text" + "!" * (k % 7)) for k in range(150)] + [("solo", "other"), ("d000", "Same; text")]
    df = spark.createDataFrame(data, "doc_id string, text_raw string")
    want = set(itertools.combinations([f"d{k:03d}" for k in range(150)], 2))
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(session, "HOT_ROWS", 20)
    assert {tuple(r) for r in formatdup.pairs(df, block=10).collect()} == want
    assert {r.record_id: (r.n_copies, r.n_rows) for r in formatdup.collapsed(df).collect()} == {"d000": (150, 151), "solo": (1, 1)}


CORPUS = [
    "Dr. {n} leads the team. We hire now. The post is open.", "Ask for Mr. {n} at noon. We pay well. The shift starts at 8.30 and ends late.",
    "Send it to St. {n} Hall. The unit is approx. 5 km away. We hire.", "The firm is new.\nWe hire.\nThe office is open.\nSend mail to Dr. {n}.",
    "We saw Mr. {n} today. The offer stands! Is it good? We think so.",
]


def learned(spark):
    names = "Adams Baker Clark Davis Evans Frank Ghosh Hills Irwin Jones".split()
    texts = [c.format(n=n) for c in CORPUS for n in names] * 3
    texts += ["{0} met {1} in {0} near {1} with {0} Group.".format(a, b) for a, b in itertools.permutations(names, 2)]
    return sentences.learn(spark.createDataFrame([(t,) for t in texts], "text string"))


@pytest.fixture(scope="module")
def model(spark):
    return learned(spark)


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Jones leads the team.", "We hire now."],
        ["The unit is approx. 5 km away.", "We hire."],
        ['The note said, "We hire. We pay." and nothing else.', "The post is open."],
        ["It costs 8.30 today.", "We think so!", "Is it (really) good?"],
        ["- We hire.", "\n", "- The post is open", "\n", "2. We pay."],
        ["City: Giza | Lead: Dr. Jones | Company: Hanlan Ltd. | Pay: 5"],
        ["今天很好。", "你呢？", "他说：“好。”"],
        ["کمپنی نئی ہے۔", "کیا ہے؟"],
    ],
)
def test_sentences(model, parts):
    text, want, line = "", [], True
    for p in parts:
        if p == "\n":
            text, line = text + p, True
            continue
        text += "" if line else " "
        want.append((len(text), len(text) + len(p)))
        text, line = text + p, False
    assert [text[a:b] for a, b in sentences.split(text, model)] == [text[a:b] for a, b in want]


@pytest.mark.parametrize(
    "lang, parts",
    [
        ("Armenian", ["Սա առաջինն է։", "Սա երկրորդն է։"]),
        ("Myanmar", ["ဤသည်ပထမဖြစ်သည်။", "ဤသည်ဒုတိယဖြစ်သည်။"]),
        ("Khmer", ["នេះជាទីមួយ។", "នេះជាទីពីរ។"]),
        ("Tibetan", ["འདི་དང་པོ་རེད།", "འདི་གཉིས་པ་རེད།"]),
        ("Greek", ["Πότε αρχίζει η δουλειά;", "Αρχίζει αύριο."]),
        ("es", ["La oferta es para los técnicos de la casa.", "El sueldo es bueno."]),
        ("de", ["Die Stelle ist noch frei und wir suchen eine Köchin.", "Das Gehalt ist gut."]),
        ("tr", ["Bu ilan çok yeni ve açık.", "Maaş da iyi olarak belirlendi."]),
        ("uk", ["Це нова робота для вас.", "Ми чекаємо на відповідь і документи."]),
        ("fa", ["این کار برای شما است؟", "ما منتظر پاسخ می مانیم."]),
        ("am", ["ይህ አዲስ ሥራ ነው።", "ደመወዙ ጥሩ ነው።"]),
    ],
)
def test_scripts_and_languages(parts, lang):
    """End marks of all scripts, without anything learned."""
    text = " ".join(parts)
    assert sentences.language(text) == {"am": "Ethiopic"}.get(lang, lang)
    assert [text[a:b] for a, b in sentences.split(text, sentences.Model())] == parts


def test_semicolons_end_greek_questions_only():
    text = "We hire; we pay."
    assert sentences.split(text, sentences.Model()) == [(0, len(text))]


def test_a_large_model_is_mapped_from_a_file(spark, model, monkeypatch):
    monkeypatch.setattr(sentences, "MODEL_ROWS", 0)
    stored = learned(spark)
    assert isinstance(stored, sentences.StoredModel)
    names = ["dr", "mr", "st", "we", "the", "approx", "no such word"]
    for kind in "SACL":
        for w in names + [f"{a}\t{b}" for a in names for b in names]:
            assert stored.get(kind, "en", w) == model.get(kind, "en", w)
    texts = [(k, c.format(n="Jones") * 3) for k, c in enumerate(CORPUS)]
    df = spark.createDataFrame(texts, "k int, t string")
    one, two = (sorted(map(tuple, sentences.sentences(df, ["k"], "t", m).collect())) for m in (model, stored))
    assert one == two and len(one) > 20


def test_collocations_need_more_than_repetition(spark):
    """A word and a small word that follow each other by chance as often as others are no collocation."""
    rng = random.Random(8)
    words = "alpha beta gamma delta kappa sigma omega".split()
    texts = [" ".join(f"We saw {rng.choice(words)} and {rng.choice(words)}. {rng.choice(words)} was {rng.choice(words)}." for _ in range(6)) for _ in range(60)]
    texts += ["He came at six p.m. sharp and we left. The shop was open at two p.m. sharp again."] * 12
    rows = sentences.statistics(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    pairs = {r.a for r in rows if r.kind == "L"}
    assert len(pairs) < 8, pairs  # of 49 pairs, nearly all met twice and more


def test_units_cover_all_text(model):
    rng = random.Random(6)
    alphabet = ["Dr.", "We", "hire.", "\n", " ", "“", "”", "(", ")", "5.", "...", "!", '"', "x", "กข", "。", "|", ":", "‏"]
    for _ in range(2000):
        text = "".join(rng.choice(alphabet) + rng.choice(["", " "]) for _ in range(rng.randint(0, 30)))
        spans = sentences.split(text, model)
        assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() and "\n" not in text[a:b] for a, b in spans)
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
        outside = "".join(text[b:c] for b, c in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(text)]))
        assert not any(ch.isalnum() for ch in outside)


def test_sentence_table(spark, model):
    data = [("a", "We hire. We pay."), ("a", "We hire. We pay."), ("b", None), ("c", ""), ("d", " \n "), ("e", "..."), ("f", "We hire. " * 20_000), (None, "Yes")]
    df = spark.createDataFrame(data, "k string, t string").withColumn("text", F.lit("clash"))
    got = sorted(map(tuple, sentences.sentences(df, ["k"], "t", model).collect()), key=repr)
    assert got[:2] == [("a", 0, 8), ("a", 9, 16)] and (None, 0, 3) in got
    assert len(got) == 2 + 20_000 + 1
    assert sentences.sentences(df.where("false"), ["k"], "t", model).count() == 0
    empty = sentences.learn(df.where("false").select(F.col("t").alias("text")))
    assert sentences.split("One two. Three four!", empty)

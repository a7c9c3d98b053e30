import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tamarisk import cli
from tamarisk.sources import corpus, log, tagger
from tamarisk.streaming import annotations

HEAD = "job_title,location,salary,profession,description,gender,country,salary_local,salary_usd,job_category,sub_category"


def csv(path, *rows, bom=False):
    lines = [HEAD, *(f't,l,1,{p},"{d}",{g},{c},1,1,cat,sub' for p, d, g, c in rows)]
    path.write_text(("﻿" if bom else "") + "\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


ROWS = [("nurse", "first\nline", "female", "Egypt"), ("cook", ' say ""hi"" ', "male ", "UAE"), ("nurse", "  ", "", "Jordan"), ("cook", "third", "", "Saudi Arabia"), ("guard", "fourth", "male", "Jordan")]


@pytest.mark.parametrize("bom", [False, True])
def test_corpus(spark, tmp_path, bom):
    path = csv(tmp_path / "ads.csv", *ROWS, bom=bom)
    docs = corpus.load(spark, path)
    got = {r.text_raw: r for r in docs.collect()}
    assert set(got) == {"first\nline", 'say "hi"', "third", "fourth"}
    assert sorted(r.country for r in got.values()) == ["AE", "EG", "JO", "SA"]
    r = got["third"]
    assert r.source_checksum == hashlib.sha256(b"third").hexdigest() and r.doc_id == r.source_checksum[:16]
    labels = {r.label: r.n for r in corpus.label_counts(corpus.scan(spark, path)).collect()}
    assert labels == {"female": 1, "male": 2, "unknown": 1}
    stats = {(r.dimension, r.value): r.n for r in corpus.describe(docs).collect()}
    assert stats["all", "all"] == 4 and stats["occupation", "cook"] == 2
    assert [r.category for r in corpus.top_categories(docs, k=2).collect()] == ["cook", "guard"]
    whole = {(r.dimension, r.value): r for r in corpus.summary(spark, path).collect()}
    assert whole["source_label", "male"].n == 2 and whole["all", "all"].n == 4
    assert next(v for k, v in whole if k == "checksum") == corpus.file_checksum(spark, path)
    unnamed = docs.withColumn("occupation", F.when(F.col("text_raw") == "third", "").when(F.col("text_raw") == "fourth", None).otherwise("x"))
    assert {(r.value, r.n) for r in corpus.describe(unnamed).where("dimension = 'occupation'").collect()} == {("(unspecified)", 2), ("x", 2)}
    assert corpus.file_checksum(spark, path) == hashlib.sha256((tmp_path / "ads.csv").read_bytes()).hexdigest()


def test_corpus_failures(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        corpus.scan(spark, str(tmp_path / "none.csv"))
    with pytest.raises(Exception, match="unmapped country"):
        corpus.load(spark, csv(tmp_path / "x.csv", ("a", "text", "m", "France"))).collect()
    with pytest.raises(corpus.EmptyCorpus):
        corpus.assert_not_empty(corpus.load(spark, csv(tmp_path / "y.csv", ("a", " ", "m", "Egypt"))))
    with pytest.raises(corpus.EmptyCorpus):
        corpus.summary(spark, str(tmp_path / "y.csv"))


def responses(spark, *rows):
    return spark.createDataFrame([(k, i, a, x, f"2024-01-0{k % 8 + 1}T00:00:00Z", None) for k, (i, a, x) in enumerate(rows)], log.RESPONSE)


def test_log_is_append_only(spark, tmp_path):
    store = log.AnnotationLog(spark, str(tmp_path / "log"))
    store.append(responses(spark, ("i1", "A1", "applicant")))
    store.append(responses(spark, ("i1", "A2", "unclear")))
    assert store.responses().count() == 2
    assert not {n for n in dir(store) if any(w in n for w in ("update", "delete", "overwrite"))}
    for bad in (("i", "A", "maybe"), ("i", "", "unclear"), ("i", "A", None)):
        with pytest.raises(ValueError):
            store.append(responses(spark, bad))
    (tmp_path / "log" / "part-x.json").write_text('{"item_id": "i1"}\n\n  \nnot json\n{"item_id": "i2"}\n[1]\n')
    with pytest.raises(ValueError, match=r"part-x\.json:4: not json; .*part-x\.json:6"):
        store.responses()
    with pytest.raises(Exception):
        store.responses(check=False).collect()
    assert [(r.line, r.text) for r in store.bad_lines().collect()] == [(4, "not json"), (6, "[1]")]
    (tmp_path / "log" / "part-x.json").unlink()
    assert store.bad_lines().count() == 0 and store.responses().count() == 2


def test_unblinding_is_logged_once(spark, tmp_path):
    book = log.UnblindingLog(spark, str(tmp_path / "book"))
    row = lambda *x: spark.createDataFrame([(*x, "2024-01-01")], log.UNBLINDING)
    assert book.entries().count() == 0
    book.append(row("t1", "me", "analysis"))
    for bad in (("t1", "you", "again"), ("t2", " ", "x"), ("t2", "me", None), (None, "me", "x")):
        with pytest.raises(ValueError):
            book.append(row(*bad))
    assert [r.blind_token for r in book.entries().collect()] == ["t1"]


def test_items(spark, tmp_path):
    path = tmp_path / "items.jsonl"
    path.write_text(json.dumps({"item_id": "i", "sentence": "s", "cue_start": 0, "cue_end": 1, "doc_type": "ad"}) + "\n")
    assert log.read_items(spark, str(path)).count() == 1
    path.write_text(json.dumps({"item_id": "i", "sentence": "s", "cue_start": 0, "cue_end": 1, "doc_type": "web"}) + "\n")
    with pytest.raises(Exception, match="doc_type"):
        log.read_items(spark, str(path)).collect()


def test_tagger_seam(spark):
    def factory():
        return lambda t: (t.split(), [[(1.0, "noun", "i", "f", "f", "N")] for _ in t.split()])

    docs = spark.createDataFrame([("d", "ab ab c"), ("e", None)], "doc_id string, text_norm string")
    got = tagger.analyse(docs, factory, toolkit_version="1", db_version="2").orderBy("index").collect()
    assert [(r["index"], r.token, r.char_start, r.char_end) for r in got] == [(0, "ab", 0, 2), (1, "ab", 3, 5), (2, "c", 6, 7)]
    assert got[0].candidates[0].pos == "noun" and got[0].toolkit_version == "1"


def test_stream_equals_batch(spark, tmp_path):
    from tamarisk.operators import annotation

    rows = [(f"i{k % 5}", f"A{k % 3}", ("applicant", "unclear", "non_applicant")[k * 7 % 3]) for k in range(40)]
    data = responses(spark, *rows)
    for part in range(3):
        data.where(F.col("seq") % 3 == part).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = annotations.read(spark, str(tmp_path / "in"), max_files=1)
    annotations.start_kappa(stream, str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination()
    got = sorted(map(tuple, annotations.kappas(spark, str(tmp_path / "out")).drop("gate_status").collect()))
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("version=")]) <= 2
    with pytest.raises(FileNotFoundError):
        annotations.kappas(spark, str(tmp_path / "none"))
    assert got == sorted(map(tuple, annotation.kappa_pairs(annotation.answers(data)).collect()))
    query = annotations.rates(stream).writeStream.outputMode("append").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "m2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("rates").columns == ["window_start", "n_answers", "unclear_rate"]


def test_cli(spark, tmp_path, capsys, monkeypatch):
    store = log.AnnotationLog(spark, str(tmp_path / "log"))
    store.append(responses(spark, ("i1", "A", "applicant"), ("i2", "A", "unclear"), ("i1", "B", "applicant"), ("i2", "B", "unclear")))
    assert cli.main(["kappa", "--log", str(tmp_path / "log"), "A", "B"], spark) == 0
    assert cli.main(["kappa", "--log", str(tmp_path / "log"), "A", "Z"], spark) == 2
    (tmp_path / "items.jsonl").write_text("".join(json.dumps({"item_id": i, "sentence": "abc", "cue_start": 0, "cue_end": 1, "doc_type": "ad"}) + "\n" for i in ("i1", "i3")))
    monkeypatch.setattr("sys.stdin.readline", lambda: "n\n", raising=False)
    import io

    monkeypatch.setattr("sys.stdin", io.StringIO("n\n"))
    assert cli.main(["annotate", "--items", str(tmp_path / "items.jsonl"), "--log", str(tmp_path / "log"), "--annotator", "A"], spark) == 0
    assert store.responses().where("item_id = 'i3' AND answer = 'non_applicant'").count() == 1
    (tmp_path / "code").write_text("x")
    (tmp_path / "m.json").write_text(json.dumps({"sources": ["code"], "lockfile": "code"}))
    run = lambda *a: cli.main(["freeze", *a, "--manifest", str(tmp_path / "m.json"), "--root", str(tmp_path)], spark)
    capsys.readouterr()
    assert run("compute") == 0
    digest = capsys.readouterr().out.strip()
    assert run("verify", "--hash", digest) == 0 and run("verify", "--hash", "0") == 1 and run("manifest") == 0

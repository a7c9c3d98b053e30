import math
import random

import pytest
from pyspark.sql import functions as F

from tamarisk.functions import cues
from tamarisk.operators import classify

C = "array<struct<score: double, pos: string, rat: string, gen: string, form_gen: string, stemcat: string>>"
T = classify.Thresholds(0.70, 0.30)


def cand(score, rat=None, gen=None, pos="noun"):
    return (score, pos, rat, gen, gen, "N")


def masses(spark, *lists):
    df = spark.createDataFrame([(k, list(x)) for k, x in enumerate(lists)], f"k int, candidates {C}")
    rows = df.select("k", cues.rationality_mass(F.col("candidates")).alias("m")).orderBy("k").collect()
    return [r.m for r in rows]


def test_mass_goldens(spark):
    a, b, c, d = masses(spark, [cand(3.0, "i"), cand(1.0, "r")], [cand(1.0, "i"), cand(1.0, "na")], [], [cand(None, "r")])
    assert (a.i, a.r, a.n) == (0.75, 0.25, None)
    assert (b.i, b.r) == (0.5, None)
    assert (c.i, c.r, c.n) == (None, None, None)
    assert (d.i, d.r, d.n) == (None, None, None)


def test_sums_are_exact_and_ordered(spark):
    rng = random.Random(1)
    lists = [[rng.uniform(0, 1) * 10 ** rng.randint(-8, 8) for _ in range(34)] for _ in range(200)]
    shuffled = [rng.sample(x, len(x)) for x in lists]
    df = spark.createDataFrame(list(enumerate(zip(lists, shuffled))), "k int, v struct<a: array<double>, b: array<double>>")
    rows = df.select("k", cues.exact_sum(F.col("v.a")).alias("a"), cues.exact_sum(F.col("v.b")).alias("b")).collect()
    assert all(r.a == r.b == math.fsum(lists[r.k]) for r in rows)


def verdict(spark, candidates, pos="noun", gen=None, form_gen=None, role=None, strict=False):
    df = spark.createDataFrame([(candidates, pos, gen, form_gen, role)], f"candidates {C}, pos string, gen string, form_gen string, role_test_passes boolean")
    r = classify.classify(df, T, strict=strict).first()
    return r.tier, r.referent, r.abstain_reason


def test_classification_goldens(spark):
    mix = lambda r, i: [cand(r, "r"), cand(i, "i")]
    assert verdict(spark, mix(0.096, 0.904)) == ("A", "non_applicant", None)
    assert verdict(spark, mix(0.747, 0.253), role=True) == ("A", "applicant", None)
    assert verdict(spark, mix(0.324, 0.676)) == ("B", "ABSTAIN", "AB1")
    assert verdict(spark, mix(0.95, 0.05)) == ("A", "ABSTAIN", "AB6")
    assert verdict(spark, mix(0.95, 0.05), role=False) == ("A", "non_applicant", None)
    assert verdict(spark, [cand(0.9, "i", "m"), cand(0.9, "i", "f")], gen="m", form_gen="f") == ("A", "ABSTAIN", "AB4")
    assert verdict(spark, mix(0.05, 0.95), gen="m", form_gen="f") == ("A", "ABSTAIN", "AB5")
    assert verdict(spark, mix(0.05, 0.95), pos="verb") == ("C", "PENDING", None)


@pytest.mark.parametrize("pos", ["verb", "adj", "adj_comp"])
def test_strict_refuses_tier_c(spark, pos):
    with pytest.raises(Exception, match=f"D7, D8.*{pos}"):
        verdict(spark, [cand(1.0, "i")], pos=pos, strict=True)


def test_cue_needs_first_pos_and_any_gender(spark):
    rows = [(0, [cand(1.0, "i", "na"), cand(0.1, "i", "f", "prep")]), (1, [cand(1.0, "i", "f", "prep")]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, f"k int, candidates {C}")
    got = {r.k: (r.cue, r.top, r.dom) for r in df.select("k", cues.is_cue(F.col("candidates")).alias("cue"), cues.top(F.col("candidates"), "pos").alias("top"), cues.dominant_gender(F.col("candidates")).alias("dom")).collect()}
    assert got == {0: (True, "noun", "f"), 1: (False, "prep", "f"), 2: (False, None, None), 3: (False, None, None)}


def test_dominant_gender_ties_go_to_m(spark):
    df = spark.createDataFrame([([cand(0.5, "i", "f"), cand(0.5, "i", "m")],)], f"candidates {C}")
    assert df.select(cues.dominant_gender(F.col("candidates"))).first()[0] == "m"


def test_divergence_and_sets(spark):
    rows = [("m", "f", True), ("f", "f", False), ("f", "na", False), (None, "f", False)]
    df = spark.createDataFrame(rows, "g string, f string, want boolean")
    assert df.where(cues.form_divergence(F.col("g"), F.col("f")) != F.col("want")).count() == 0
    one = spark.createDataFrame([(["n", "r"],)], "x array<string>").select(cues.canonical_set(F.col("x"))).first()[0]
    assert one == ["r", "n"]
    with pytest.raises(ValueError):
        cues.retained(F.col("x"), 50)
    assert not set(cues.CONTENT_POS) & set(cues.EXCLUDED_POS)


@pytest.mark.parametrize("high, low", [(0.3, 0.7), (1.1, 0.2), (0.5, -0.1)])
def test_thresholds_are_checked(high, low):
    with pytest.raises(ValueError):
        classify.Thresholds(high, low)
    with pytest.raises(TypeError):
        classify.Thresholds()


def test_sweep_reproduces_published_counts(spark):
    from tamarisk.plans.registry import CASES

    schema = "label string, mass_r double, mass_i double, expected string"
    grid = classify.grid(spark, 200)
    assert grid.count() == 20_301
    for cases, n in ((CASES, 2_249), (CASES[:7], 4_950)):
        assert classify.feasible(classify.sweep(grid, spark.createDataFrame(list(cases), schema))).count() == n
    no = spark.createDataFrame([("a", 0.9, 0.1, "r"), ("b", 0.9, 0.1, "i")], schema)
    empty = classify.feasible(classify.sweep(grid, no))
    assert empty.count() == 0 and classify.ranges(empty).first()[0] is None


def test_sweep_of_many_cases(spark, monkeypatch):
    """Cases beyond a block give the same rows."""
    grid = classify.grid(spark, 10)
    cases = spark.createDataFrame([(f"c{k}", k / 40, 1 - k / 40, ("r", "i", None)[k % 3]) for k in range(40)], "label string, mass_r double, mass_i double, expected string")
    one = sorted(map(tuple, classify.sweep(grid, cases).collect()))
    monkeypatch.setattr(classify, "CASE_BLOCK", 7)
    assert sorted(map(tuple, classify.sweep(grid, cases).collect())) == one and len(one) == 40 * 66

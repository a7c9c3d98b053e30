import math
import random
from statistics import NormalDist, fmean

import pytest
from pyspark.sql import functions as F

from tamarisk.functions import stats
from tamarisk.operators import inference, reporting, scoring, variance


def cells(spark, data):
    return spark.createDataFrame(data, "ad_id string, pair_id string, difference double")


def generated(spark, ads, pairs, **config):
    a = spark.range(ads).select(F.col("id").cast("string"))
    b = spark.range(pairs).select(F.col("id").cast("string"))
    return scoring.Synthetic(**config).score_pairs(a, b)


def test_distributions(spark):
    df = spark.createDataFrame([(x / 8,) for x in range(-72, 73)], "x double")
    for r in df.select("x", stats.normal_cdf(F.col("x")).alias("p")).collect():
        assert r.p == pytest.approx(NormalDist().cdf(r.x), abs=1e-15)

    def t_cdf(t, n, steps=20_000):
        end = math.atan(t / math.sqrt(n))
        f = lambda u: math.cos(u) ** (n - 1)
        h = end / steps
        area = h / 3 * (f(0) + f(end) + sum((4 if k % 2 else 2) * f(k * h) for k in range(1, steps)))
        return 0.5 + area * math.gamma((n + 1) / 2) / math.gamma(n / 2) / math.sqrt(math.pi)

    points = [(t, n) for t in (-3.2, -1.0, 0.0, 0.4, 2.5) for n in (1, 2, 3, 4, 9, 30, 101)]
    df = spark.createDataFrame(points, "t double, n int")
    for r in df.select("t", "n", stats.student_t_cdf(F.col("t"), F.col("n")).alias("p")).collect():
        assert r.p == pytest.approx(t_cdf(r.t, r.n), abs=1e-9)


def brute(data):
    ads = sorted({a for a, _, _ in data})
    pairs = sorted({p for _, p, _ in data})
    mu = fmean(x for *_, x in data)
    by = lambda i, k: sum(r[2] - mu for r in data if r[i] == k)
    va, vp = sum(by(0, a) ** 2 for a in ads), sum(by(1, p) ** 2 for p in pairs)
    vc = sum((x - mu) ** 2 for *_, x in data)
    v = va + vp - vc
    return mu, math.sqrt((v if v > 0 else max(va, vp)) / len(data) ** 2)


def test_cluster_robust_against_brute_force(spark):
    rng = random.Random(2)
    data = [(f"a{a}", f"p{p}", a * 0.3 + p * 0.2 + rng.gauss(0, 1)) for a in range(6) for p in range(5)]
    mu, se = brute(data)
    for df in (cells(spark, data), cells(spark, data[::-1]).repartition(7)):
        r = variance.cluster_robust(df).first()
        assert (r.mean_difference, r.se, r.n, r.n_ads, r.n_pairs) == (pytest.approx(mu), pytest.approx(se), 30, 6, 5)
        assert variance.CLUSTERING in r.clustering
    flat = [("a0", "p0", 1.0), ("a0", "p1", -1.0), ("a1", "p0", -1.0), ("a1", "p1", 1.0)]
    assert "not positive" in variance.cluster_robust(cells(spark, flat)).first().clustering


@pytest.mark.parametrize("scale", [1e-12, 1e-9, 1e9, 1e12])
def test_any_scale(spark, scale):
    rng = random.Random(3)
    data = [(f"a{a}", f"p{p}", a * 0.3 + p * 0.2 + rng.gauss(0, 1)) for a in range(6) for p in range(5)]
    one, other = cells(spark, data), cells(spark, [(a, p, x * scale) for a, p, x in data])
    for f, power in ((variance.cluster_robust, 1), (variance.components, 2), (variance.inflation, 0)):
        x, y = f(one).first().asDict(), f(other).first().asDict()
        for k, v in x.items():
            assert y[k] == (v if isinstance(v, (int, str)) else pytest.approx(v * (scale if k == "mean_difference" else scale**power), rel=1e-9))


def test_designs_are_checked(spark):
    for missing in (("a", None, 1.0), (None, "p", 1.0), ("a", "p", None)):
        with pytest.raises(ValueError, match="null"):
            variance.design(cells(spark, [("b", "q", 1.0), missing]))
    with pytest.raises(ValueError, match="balanced"):
        variance.components(cells(spark, [("a", "p", 1.0), ("a", "q", 2.0), ("b", "p", 3.0)]))
    with pytest.raises(ValueError, match="two"):
        variance.components(cells(spark, [("a", "p", 1.0), ("a", "q", 2.0)]))
    with pytest.raises(ValueError, match="twice"):
        variance.design(cells(spark, [("a", "p", 1.0), ("a", "p", 2.0)]))
    with pytest.raises(ValueError):
        variance.design(cells(spark, []))
    with pytest.raises(Exception, match="two differences"):
        variance.naive_se(cells(spark, [("a", "p", 1.0)])).collect()
    with pytest.raises(ValueError):
        scoring.Synthetic(sd_ad=-1)


def test_known_truth_is_recovered(spark):
    for effect in (0.0, 0.5):
        d = generated(spark, 40, 50, effect=effect, sd_ad=1.0, sd_pair=1.0, seed=13)
        r = variance.cluster_robust(d).first()
        assert abs(r.mean_difference - effect) < 1.96 * r.se + 0.05
    resid = variance.components(generated(spark, 40, 50, seed=17)).first()
    assert resid.sigma2_resid == pytest.approx(2.0, rel=0.2)


def test_level_effects_cancel_and_interactions_inflate(spark):
    """Level effects don't enter a difference, so errors are not inflated on average; one design alone scatters."""
    plain = [variance.inflation(generated(spark, 40, 50, sd_ad=3.0, sd_pair=3.0, seed=k)).first()[0] for k in range(20)]
    strong = variance.inflation(generated(spark, 40, 50, sd_ad_gender=0.8, sd_pair_gender=0.8, seed=23)).first()[0]
    assert fmean(plain) == pytest.approx(1, abs=0.1)
    assert strong > 2


def test_generator_ignores_partitions(spark):
    model = scoring.Synthetic(effect=0.2, sd_ad=1.0, seed=3)
    ids = spark.range(20).select(F.col("id").cast("string"))
    a = sorted(map(tuple, model.score_pairs(ids.repartition(2), ids).collect()))
    b = sorted(map(tuple, model.score_pairs(ids.repartition(7), ids.union(ids)).collect()))
    assert a == b and len(a) == 400


def test_empty_and_large_designs(spark, monkeypatch):
    ids = spark.range(7).select(F.col("id").cast("string"))
    for a, b in ((ids.where("false"), ids), (ids, ids.where("false"))):
        with pytest.raises(ValueError, match="empty design"):
            scoring.Synthetic().score_pairs(a, b)
    small = sorted(map(tuple, scoring.Synthetic().score_pairs(ids, ids).collect()))
    monkeypatch.setattr(scoring, "BROADCAST_ROWS", 2)  # blocks in place of a broadcast
    assert sorted(map(tuple, scoring.Synthetic().score_pairs(ids, ids).collect())) == small and len(small) == 49


def test_holm(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.05), ("g", "x", 0.9)], "family string, label string, p_value double")
    got = {r.label: (r.p_adjusted, r.reject) for r in inference.holm(df).collect()}
    assert got["a"] == (pytest.approx(0.03), True) and got["b"][0] == got["c"][0] == pytest.approx(0.08)
    assert inference.holm_summary(inference.holm(df)).count() == 2
    for bad in (("", "a", 0.1), ("f", "a", 1.5), ("f", "a", None)):
        with pytest.raises(Exception, match="family"):
            inference.holm(spark.createDataFrame([bad], "family string, label string, p_value double")).collect()


def test_tost_and_power(spark):
    df = spark.createDataFrame([(0.001, 0.01, 0.05, 100), (0.001, 0.5, 0.05, 100)], "difference double, se double, margin double, df int")
    assert [r.equivalent for r in inference.tost(df).orderBy("se").collect()] == [True, False]
    with pytest.raises(Exception, match="positive"):
        inference.tost(df.withColumn("se", F.lit(0.0))).collect()
    assert inference.required_ads((0.1, 10.0, 0.1), 0.01, 50) is None
    n = inference.required_ads((0.5, 0.3, 2.0), 0.3, 50)
    grid = spark.createDataFrame([(n - 1,), (n,)], "n_ads bigint")
    low, high = (r.power for r in inference.power_curve(grid, (0.5, 0.3, 2.0), 0.3, 50).orderBy("n_ads").collect())
    assert low < 0.8 <= high


def test_verdicts_put_power_first(spark):
    data = [("a", 0.3, 0.8, True, True), ("b", 0.9, 0.8, True, True), ("c", 0.9, 0.8, False, True), ("d", 0.9, 0.8, None, None)]
    df = spark.createDataFrame(data, "label string, achieved_power double, power_floor double, equivalent boolean, significant boolean")
    got = {r.label: r.verdict for r in reporting.verdicts(df).collect()}
    assert got == {"a": "inconclusive", "b": "equivalent-within-margin", "c": "difference-detected", "d": "inconclusive"}
    with pytest.raises(Exception, match="power"):
        reporting.verdicts(df.withColumn("achieved_power", F.lit(1.5))).collect()


REFUSED = ["no bias", "No-Bias", "NO  BIAS", "bias free", "unbiased", "no evidence of bias", "the model is fair"]
ALLOWED = ["fairness was studied", "fairly small", "inconclusive", "bias was measured", "fair-ness", None]


def test_claims(spark):
    df = spark.createDataFrame([(t, True) for t in REFUSED] + [(t, False) for t in ALLOWED], "t string, bad boolean")
    assert df.where(reporting.forbidden(F.col("t")) != F.col("bad")).collect() == []
    with pytest.raises(Exception, match="license"):
        df.select(reporting.guarded(F.col("t"))).collect()


def test_report(spark):
    d = generated(spark, 5, 5, seed=2)
    line = variance.cluster_robust(d).select(F.lit("cell").alias("label"), reporting.interval_text().alias("text"))
    assert variance.CLUSTERING in line.first().text
    cell = spark.createDataFrame([("cell", 0.9, 0.8, False, False)], "label string, achieved_power double, power_floor double, equivalent boolean, significant boolean")
    out = reporting.render(line, reporting.verdicts(cell), 0.25)
    assert "Abstention rate: 0.2500" in out and "inconclusive" in out
    with pytest.raises(reporting.ForbiddenClaim):
        reporting.render(line.withColumn("label", F.lit("unbiased cell")), reporting.verdicts(cell))

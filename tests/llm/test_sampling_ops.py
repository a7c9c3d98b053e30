"""Proportional samples and stable samples."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tamarisk.llm import proportional, stable

PLAN = "plan_id bigint, batch_id string, field string, seed bigint, requested int, note string"
TARGET = "plan_id bigint, category string, target_share double, min_rows int, salt string"
ALIAS = "field string, alias string, category string"


def units(spark, sizes, batch="b", field="country", parts=None):
    data = [(batch, field, c, f"{c}{k:05d}") for c, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(data, "batch_id string, field string, category string, unit_id string")
    return df.repartition(parts) if parts else df


def run(spark, sizes, targets, requested=100, seed=7, parts=None):
    plans = spark.createDataFrame([(1, "b", "country", seed, requested, "x")], PLAN)
    t = spark.createDataFrame([(1, c, s, m, "x") for c, (s, m) in targets.items()], TARGET)
    drawn, report = proportional.sample(plans, t, units(spark, sizes, parts=parts))
    return sorted((r.category, r.unit_id) for r in drawn.collect()), {r.category: r for r in report.collect()}


def test_frame_maps_written_values(spark):
    docs = spark.createDataFrame(
        [("b", "d1", " EGYPT "), ("b", "d1", "egypt"), ("b", "d2", "??"), ("b", "d3", None), ("b", None, "egypt"), (None, "d4", "egypt"), ("b", "d5", "مصر")],
        "batch_id string, doc_id string, country string",
    ).withColumn("field", F.lit("clash")).withColumn("alias", F.lit("clash")).withColumn("category", F.lit("clash"))
    aliases = spark.createDataFrame([("country", "egypt", "EG"), ("country", "مصر", "EG"), ("pos", "egypt", "no")], ALIAS)
    got = sorted(map(tuple, proportional.frame(docs, "doc_id", ["country"], aliases).collect()))
    assert got == [("b", "country", "EG", "d1"), ("b", "country", "EG", "d5")]
    assert proportional.frame(docs.where("false"), "doc_id", ["country"], aliases).count() == 0


def test_shares_floors_and_shortfalls(spark):
    got, report = run(spark, {"A": 1000, "B": 300, "C": 4, "D": 40}, {"A": (0.6, 0), "B": (0.3, 5), "C": (0.1, 2), "D": (0.0, 8), "E": (0.0, 1)})
    n = Counter(c for c, _ in got)
    assert n == {"A": 60, "B": 30, "C": 4, "D": 8}
    assert {c: (r.available, r.drawn, r.met) for c, r in report.items()} == {"A": (1000, 60, True), "B": (300, 30, True), "C": (4, 4, False), "D": (40, 8, True), "E": (0, 0, False)}
    assert len(set(got)) == len(got)


def test_fractional_targets(spark):
    """Where units abound, a fractional target is met by the whole number below it or above."""
    plans = spark.createDataFrame([(k, "b", "country", k, 13, "x") for k in range(8)], PLAN)
    t = spark.createDataFrame([(k, c, s, 0, "x") for k in range(8) for c, s in (("A", 0.3), ("B", 0.25), ("C", 0.45))], TARGET)
    _, report = proportional.sample(plans, t, units(spark, {c: 100 for c in "ABC"}))
    rows = report.collect()
    assert len(rows) == 24 and all(r.met and abs(r.drawn - r.target) < 1 for r in rows)
    assert {sum(r.drawn for r in rows if r.plan_id == k) for k in range(8)} == {13}
    _, report = run(spark, {"A": 3, "B": 4, "C": 100}, {"A": (0.39, 0), "B": (0.39, 4), "C": (0.22, 3)}, requested=10)
    assert {c: (r.drawn, r.met) for c, r in report.items() if c != "C"} == {"A": (3, False), "B": (4, True)} and report["C"].drawn == 3
    starts = proportional.cells(spark.createDataFrame([(k, "b", "country", 1, 13, "x") for k in range(8)], PLAN), t, units(spark, {"A": 5})).select("start").distinct()
    assert starts.count() == 8  # plans of one seed don't share a start


def test_draw_is_independent_of_partitions_and_buckets(spark, monkeypatch):
    args = ({"A": 500, "B": 77}, {"A": (0.7, 0), "B": (0.3, 40)})
    base, _ = run(spark, *args)
    assert run(spark, *args, parts=13)[0] == base and run(spark, *args, seed=8)[0] != base
    monkeypatch.setattr(proportional, "BUCKET_ROWS", 9)
    assert Counter(c for c, _ in run(spark, *args)[0]) == {"A": 70, "B": 40}
    monkeypatch.setattr(proportional, "BROADCAST_ROWS", 0)  # the salted join
    assert Counter(c for c, _ in run(spark, *args)[0]) == {"A": 70, "B": 40}


def test_inclusion_is_even(spark):
    plans = spark.createDataFrame([(k, "b", "country", k, 10, "x") for k in range(300)], PLAN)
    t = spark.createDataFrame([(k, "A", 1.0, 0, "x") for k in range(300)], TARGET)
    drawn, _ = proportional.sample(plans, t, units(spark, {"A": 40}))
    n = Counter(r.unit_id for r in drawn.collect())
    assert len(n) == 40 and sum(n.values()) == 3000 and all(40 < x < 120 for x in n.values())


def test_plans_with_nulls_and_repeats(spark):
    plans = spark.createDataFrame([(1, "b", "country", None, 10, "x")] * 2 + [(None, "b", "country", 1, 5, "x"), (2, None, "country", 1, None, "x")], PLAN)
    t = spark.createDataFrame([(1, "A", 0.5, None, "x")] * 2 + [(1, None, 0.5, 1, "x"), (2, "A", None, 1, "x"), (3, "A", 1.0, 1, "x")], TARGET)
    drawn, report = proportional.sample(plans, t, units(spark, {"A": 9}))
    assert {(r.plan_id, r.category, r.drawn, r.met) for r in report.collect()} == {(1, "A", 5, True), (2, "A", 0, False)}
    assert drawn.count() == 5
    empty = proportional.sample(plans.where("false"), t, units(spark, {"A": 9}))
    assert [x.count() for x in empty] == [0, 0]


SP = "plan_id bigint, seed bigint, rate double"


def members(registry, plans):
    out = {}
    for r in stable.members(registry, plans).collect():
        out.setdefault(r.plan_id, set()).add(r.id)
    return out


def test_stable_samples_only_grow(spark, tmp_path):
    plans = spark.createDataFrame([(1, 42, 0.1), (2, 42, 0.3), (3, -7, 0.25), (4, None, 0.0), (5, 1, None), (6, 3, 2.0), (1, 42, 0.1)], SP)
    rows = [(f"c{k}",) for k in range(3000)]
    path = str(tmp_path / "registry")
    early = spark.createDataFrame(rows[:1500] + rows[:50] + [(None,)], "cue_id string").withColumn("prn", F.lit("clash")).withColumn("id", F.lit("clash"))
    first = members(stable.register(early, path, "cue_id"), plans)
    written = {r.id: r.prn for r in stable.registered(spark, path).collect()}
    later = stable.register(spark.createDataFrame(rows, "cue_id string").repartition(5), path, "cue_id")
    second = members(later, plans)
    assert later.count() == 3000 and all(written[r.id] == r.prn for r in later.collect() if r.id in written)
    assert set(first) == set(second) == {1, 2, 3, 6}
    for p, rate in ((1, 0.1), (2, 0.3), (3, 0.25), (6, 1.0)):
        assert first[p] <= second[p] and abs(len(second[p]) / 3000 - rate) < 0.03
    assert second[1] <= second[2]
    assert stable.current(early, later, "cue_id").count() == 1500
    numbers, spans = stable.positions(later, plans, bucket_rows=100)
    order = {r.position: r.id for r in numbers.collect()}
    assert sorted(order) == list(range(3000)) and spans.count() == 6
    for r in spans.collect():
        assert {order[(r.first + k) % 3000] for k in range(r.n_chosen)} == second.get(r.plan_id, set())
    assert all(r.n_plans == sum(r.id in ids for ids in second.values()) for r in numbers.collect())


def test_stable_extremes(spark, tmp_path):
    none = spark.createDataFrame([], "cue_id string")
    registry = stable.register(none, str(tmp_path / "r"), "cue_id")
    plans = spark.createDataFrame([(1, 1, 0.5)], SP)
    numbers, spans = stable.positions(registry, plans)
    assert registry.count() == numbers.count() == 0 and spans.first().n_chosen == 0
    registry = stable.register(spark.createDataFrame([("a",)], "cue_id string"), str(tmp_path / "r"), "cue_id")
    numbers, spans = stable.positions(registry, plans.where("false"))
    assert numbers.first().n_plans == 0 and spans.count() == 0


def test_membership_is_the_arc(spark):
    rng = random.Random(5)
    numbers = spark.createDataFrame([(f"i{k}", rng.random()) for k in range(2000)], stable.SCHEMA)
    plans = spark.createDataFrame([(k, rng.randint(-99, 99), rng.choice([0.01, 0.5, 0.99])) for k in range(40)], SP)
    start = {r.plan_id: r.s for r in plans.select("plan_id", stable.start(F.col("seed")).alias("s")).collect()}
    want = {(p.plan_id, n.id) for p in plans.collect() for n in numbers.collect() if (n.prn - start[p.plan_id]) % 1.0 < p.rate}
    assert {(r.plan_id, r.id) for r in stable.members(numbers, plans).collect()} == want
    exact = numbers.withColumn("prn", F.floor(F.col("prn") * 2.0**52) / 2.0**52)
    ranked, spans = stable.positions(exact, plans, bucket_rows=150)
    order = {r.position: r.id for r in ranked.collect()}
    inside = {(r.plan_id, order[(r.first + k) % 2000]) for r in spans.collect() for k in range(r.n_chosen)}
    assert inside == {(r.plan_id, r.id) for r in stable.members(exact, plans).collect()}



"""Consensus of several annotators' labels: confidence-aware truth discovery.

Labels and weights are estimated in turn until they stay. An item holds a
distribution over the labels; an annotator's weight is the lower chi-squared
quantile of the number of answers over the sum of squared errors, i.e. the
inverse of the upper confidence bound of the error variance, so contributors
with few answers (the long tail) count less. An answer's squared error is its
squared distance, as a unit vector, to what its item holds.

Plain (``confusion=False``): an item holds the weighted mean of its answers,
which minimises the weighted squared distance. An annotator who always gives
one label or turns two round is only a bad one then, and errors depend on the
label. So by default the distance of an answer to a label is its negative log
frequency under that label in the annotator's own confusion counts, an item
holds the softmax of the weighted sums, and squared errors are divided by
those that the confusion counts let expect, at least 1 on average: fewer errors
than expected are no merit, as they come from an annotator's own pull on the
labels, on whom all weight would fall in the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarisk.llm.proportional import BLANK, stripped
from tamarisk.session import BROADCAST_ROWS, cut, join_split

LABELS = ("applicant", "non_applicant", "unclear")


def _lower_gamma(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-15:
            k += 1
            term *= x / k
            total += term
        return total * front
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        f = -i * (i - a)
        b += 2
        d = 1 / (f * d + b)
        c = b + f / c
        h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return 1 - h * front


def chi2_quantile(p: float, n: float) -> float:
    """Quantile p of chi-squared with n degrees of freedom."""
    if n <= 0:
        return 0.0
    if n > 200:  # Wilson and Hilferty; exact to 4 digits here
        z = _normal_quantile(p)
        return n * (1 - 2 / (9 * n) + z * math.sqrt(2 / (9 * n))) ** 3
    low, high = 0.0, n + 20 * math.sqrt(2 * n) + 20
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _lower_gamma(n / 2, mid / 2) < p else (low, mid)
    return (low + high) / 2


def _normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def votes(responses: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """One row per (item, annotator): the valid answer with the highest seq.

    Case, outer blanks and blanks or hyphens for underscores don't matter.
    Other and null answers, null items and null annotators give no row;
    repeated rows count once; a null seq is the lowest.
    """
    said = F.regexp_replace(F.lower(stripped(F.col("answer"))), rf"(?:{BLANK}|[-_‐-―])+", "_")
    code = F.array_position(F.array(*map(F.lit, labels)), said).cast("int") - 1
    rows = responses.select("item_id", "annotator_id", F.struct("seq", code.alias("label")).alias("v"))
    rows = rows.where("item_id IS NOT NULL AND annotator_id IS NOT NULL AND v.label >= 0")
    return rows.groupBy("item_id", "annotator_id").agg(F.max("v").alias("v")).select("item_id", "annotator_id", F.col("v.label").alias("label"))


def _softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores)
    parts = [F.exp(s - top) for s in scores]
    return [p / sum(parts[1:], parts[0]) for p in parts]


def _quantile(n: Column, alpha: float) -> Column:
    def run(ns: pd.Series) -> pd.Series:
        return pd.Series([chi2_quantile(alpha / 2, k) for k in ns], dtype=float)

    return F.pandas_udf(run, "double")(n)


def estimate(
    responses: DataFrame,
    labels: tuple[str, ...] = LABELS,
    turns: int = 50,
    alpha: float = 0.05,
    smoothing: float = 5.0,
    confusion: bool = True,
    tolerance: float = 1e-3,
) -> tuple[DataFrame, DataFrame]:
    """Consensus per item and reliability per annotator.

    Items: item_id, answer, n_annotators, agreement (share of the answers that
    equal the consensus), confidence (its probability). Annotators:
    annotator_id, n_answers, reliability (probability of the right answer,
    over the labels as common as they are), error_bound (upper confidence
    bound of the error rate), weight.

    The turns end when no annotator's frequency (plain: share of the weight)
    moves by ``tolerance``, at the latest after ``turns``. Votes are shuffled
    once, into one row per item with a list of at most one vote of each
    annotator, and checkpointed. While the annotators are counted to be at most
    BROADCAST_ROWS, a turn is one scan of these rows: the model, a row for each
    annotator and answer, is made on the driver and broadcast as a single row
    of arrays, and only partial sums by (annotator, answer) are shuffled,
    however busy one annotator is. Beyond that, the model stays a checkpointed
    table and each turn joins votes and model by a shuffle that splits busy
    annotators. Ties go to the label with more votes, then to the earlier of
    ``labels``. No valid answers: empty results.
    """
    k = range(len(labels))
    flat = votes(responses, labels)
    people = cut(flat.groupBy("annotator_id").agg(F.count("*").alias("n_answers")))
    few = people.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few:
        # dense numbers, so that a model row is found by its place in an array
        numbered = people.withColumn("who", F.row_number().over(W.orderBy("annotator_id")) - 1)
        voted = flat.join(F.broadcast(numbered.select("annotator_id", "who")), "annotator_id")
        size = numbered.count()
    else:
        numbered = people.withColumn("who", F.col("annotator_id"))
        voted = flat.withColumn("who", F.col("annotator_id"))
        size = 0
    vote = F.struct("who", "label")
    items = cut(voted.groupBy("item_id").agg(F.array_sort(F.collect_list(vote)).alias("votes"))).withColumn("n", F.size("votes"))
    tally = [F.size(F.filter("votes", lambda v, t=t: v["label"] == t)).alias(f"n{t}") for t in k]
    held = items.select("*", *[(c / F.col("n")).alias(f"p{t}") for t, c in enumerate(tally)])
    model = None
    for _ in range(turns):
        sums = _sums(held, len(labels))
        before, model = model, _Model.fit(sums, few, len(labels), alpha, smoothing, confusion)
        if model is None:  # no votes at all
            break
        held = model.held(items, size)
        if before is not None and model.moved(before) < tolerance:
            break
    best = F.array_max(F.array(*[F.struct(F.round(f"p{t}", 9).alias("p"), tally[t].alias("n"), F.lit(-t).alias("t")) for t in k]))
    names = F.array(*map(F.lit, labels))
    found = held.select("item_id", "n", best.alias("b")).select(
        "item_id",
        F.element_at(names, F.lit(1) - F.col("b.t")).alias("answer"),
        F.col("n").cast("int").alias("n_annotators"),
        (F.col("b.n") / F.col("n")).alias("agreement"),
        F.col("b.p").alias("confidence"),
    )
    if model is None:
        none = "annotator_id string, n_answers bigint, reliability double, error_bound double, weight double"
        return found, people.sparkSession.createDataFrame([], none)
    quality = model.table(items.sparkSession).groupBy("who").agg(F.sum("right").alias("reliability"), F.max("weight").alias("weight"), F.max("bound").alias("bound"))
    quality = numbered.join(quality, "who").select("annotator_id", "n_answers", "reliability", F.least(F.lit(1.0), (1 - F.col("reliability")) * F.col("bound")).alias("error_bound"), "weight")
    return found, quality


def _sums(held: DataFrame, n: int) -> DataFrame:
    """Per (who, label): answers, what their items hold (c), its second moments (m) and its share by item (q)."""
    k = range(n)
    each = held.select("n", *[f"p{t}" for t in k], F.explode("votes").alias("v")).select("v.who", "v.label", "n", *[f"p{t}" for t in k])
    return each.groupBy("who", "label").agg(
        F.count("*").alias("answers"),
        *[F.sum(f"p{t}").alias(f"c{t}") for t in k],
        *[F.sum(F.col(f"p{t}") * F.col(f"p{u}")).alias(f"m{t}_{u}") for t in k for u in k if t <= u],
        *[F.sum(F.col(f"p{t}") / F.col("n")).alias(f"q{t}") for t in k],
    )


class _Model:
    """A row per (who, label): s0, s1, ... (what such an answer adds to each label), f (the frequency
    watched for convergence), right (its part of the reliability), weight and bound.

    ``rows`` on the driver while annotators are few, else a checkpointed ``frame``.
    """

    def __init__(self, n: int, confusion: bool, prior: list[float], rows: list[tuple] | None, frame: DataFrame | None):
        self.n, self.confusion, self.prior, self.rows, self.frame = n, confusion, prior, rows, frame
        self.columns = ["who", "label", "weight", "bound", "right", "f", *[f"s{t}" for t in range(n)]]

    @classmethod
    def fit(cls, sums: DataFrame, few: bool, n: int, alpha: float, smoothing: float, confusion: bool) -> _Model | None:
        k = range(n)
        if few:
            counts = sums.collect()
            total = [sum(r[f"q{t}"] for r in counts) for t in k]
        else:
            sums = cut(sums)
            total = [x or 0.0 for x in sums.agg(*[F.sum(f"q{t}") for t in k]).first()]
        if not sum(total):
            return None
        prior = [q / sum(total) for q in total]
        if few:
            by: dict = {}
            for r in counts:
                by.setdefault(r.who, []).append(r)
            quantile = {m: chi2_quantile(alpha / 2, m) for m in {sum(r.answers for r in own) for own in by.values()}}
            rows = [x for own in by.values() for x in _rows(own, n, quantile, smoothing, confusion, prior)]
            return cls(n, confusion, prior, rows, None)
        # the same from each annotator's rows, at most one per label, gathered in one
        own = F.collect_list(F.struct(*sums.columns))
        gathered = sums.groupBy("who").agg(own.alias("own"), F.sum("answers").alias("answers")).withColumn("q", _quantile(F.col("answers"), alpha))
        kind = "array<struct<who:string,label:int,weight:double,bound:double,right:double,f:double," + ",".join(f"s{t}:double" for t in k) + ">>"

        @F.pandas_udf(kind)
        def model_rows(own: pd.Series, answers: pd.Series, q: pd.Series) -> pd.Series:
            return pd.Series([list(_rows([Row(**x) for x in o], n, {a: b}, smoothing, confusion, prior)) for o, a, b in zip(own, answers, q)])

        frame = gathered.select(F.explode(model_rows("own", "answers", "q")).alias("m")).select("m.*")
        return cls(n, confusion, prior, None, cut(frame))

    def table(self, spark) -> DataFrame:
        if self.frame is not None:
            return self.frame
        return spark.createDataFrame(self.rows, "who int, label int, weight double, bound double, right double, f double, " + ", ".join(f"s{t} double" for t in range(self.n)))

    def moved(self, before: _Model) -> float:
        """The largest change of a watched frequency."""
        if self.rows is not None:
            old = {r[:2]: r[5] for r in before.rows}
            return max(abs(r[5] - old.get(r[:2], 0.0)) for r in self.rows)
        both = self.frame.select("who", "label", "f").join(before.frame.select("who", "label", F.col("f").alias("g")), ["who", "label"])
        return both.agg(F.max(F.abs(F.col("f") - F.col("g")))).first()[0]

    def held(self, items: DataFrame, size: int) -> DataFrame:
        """items with p0, p1, ...: what each holds."""
        k = range(self.n)
        if self.rows is None:
            each = items.select("item_id", F.explode("votes").alias("v")).select("item_id", "v.who", "v.label")
            each = join_split(each, self.frame, ["who", "label"], F.col("item_id"))
            scored = items.join(each.groupBy("item_id").agg(*[F.sum(f"s{t}").alias(f"s{t}") for t in k]), "item_id")
        else:
            place = {r[0] * self.n + r[1]: r for r in self.rows}
            arrays = [F.array(*[F.lit(float(place[i][6 + t]) if i in place else 0.0) for i in range(size * self.n)]) for t in k] if size * self.n <= 1_000 else None
            if arrays is None:
                table = tuple([float(place[i][6 + t]) if i in place else 0.0 for i in range(size * self.n)] for t in k)
                one = items.sparkSession.createDataFrame([table], ", ".join(f"a{t} array<double>" for t in k))
                rows = items.join(F.broadcast(one))
                arrays = [F.col(f"a{t}") for t in k]
            else:
                rows = items
            total = lambda t: F.aggregate("votes", F.lit(0.0), lambda s, v: s + F.get(arrays[t], v["who"] * self.n + v["label"]))
            scored = rows.select(*items.columns, *[total(t).alias(f"s{t}") for t in k])
        if self.confusion:
            parts = _softmax([F.col(f"s{t}") + F.lit(math.log(max(self.prior[t], 1e-9))) for t in k])
        else:
            all_ = sum((F.col(f"s{t}") for t in k), F.lit(0.0))
            parts = [F.col(f"s{t}") / all_ for t in k]
        return scored.select(*items.columns, *[p.alias(f"p{t}") for t, p in enumerate(parts)])


def _rows(own: list, n: int, quantile: dict, smoothing: float, confusion: bool, prior: list[float]) -> Iterator[tuple]:
    """The model rows of one annotator from the sums of each of the answers.

    Every annotator gets ``smoothing`` answers a label beforehand, three fifths
    of them right. Answers an annotator never gave have no row and need none.
    """
    k = range(n)
    answers = sum(r["answers"] for r in own)
    chi2 = quantile[answers]
    c = {r["label"]: [r[f"c{t}"] for t in k] for r in own}
    moment = [[sum(r[f"m{min(t, u)}_{max(t, u)}"] for r in own) for u in k] for t in k]
    norms = sum(moment[t][t] for t in k)
    observed = answers + norms - 2 * sum(x[label] for label, x in c.items())
    if not confusion:
        weight = chi2 / max(observed, 1e-9)
        for label in c:
            yield (own[0]["who"], label, weight, answers / chi2, (1 - observed / 2 / answers) / len(c), 1 - observed / 2 / answers, *(weight if t == label else 0.0 for t in k))
        return
    wrong = 0.4 / max(1, n - 1)
    under = [sum(x[t] for x in c.values()) + smoothing for t in k]
    none = [0.0] * n
    often = [[(c.get(b, none)[t] + smoothing * (0.6 if b == t else wrong)) / under[t] for t in k] for b in k]
    expected = answers + norms - 2 * sum(often[b][t] * moment[t][b] for b in k for t in k)
    weight = chi2 / (answers * max(1.0, observed / max(expected, 1e-9)))
    for label in c:
        f = often[label]
        yield (own[0]["who"], label, weight, answers / chi2, f[label] * prior[label], f[label], *(weight * math.log(x) for x in f))

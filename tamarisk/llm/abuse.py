"""Abusive, hateful or sexual content: a counterfactually regularised classifier.

A logistic model over words, word pairs and character n-grams scores every
passage of a text. It is trained on labelled sentences. For each sentence that
names a group of people, copies with other groups put in its place join the
training, and the model pays for score differences between the copies, so that
it can't learn the groups instead of what is said about them. Copies in
disguise (spaced, starred, stretched or decorated letters) teach spelling.
Unlabelled texts of the corpus itself show what is ordinary there.
"""

from __future__ import annotations

import hashlib
import html
import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.abuse_labels import ABUSIVE, NEUTRAL, SLOTS
from tamarisk.session import cut

#: Bound of the labelled sample: copies made of each labelled sentence.
COPIES = 12
#: A passage of more words is scored in overlapping windows of this many.
WINDOW = 24
#: A word of more characters, as scripts without blanks have, is scored in overlapping pieces of this many.
PIECE = 24
#: Unlabelled texts of the corpus that the model is adapted to, at most.
BACKGROUND = 4_000
#: Characters they have together, at most.
BACKGROUND_CHARS = 20_000_000
#: A passage in more than this share of them, and in more than so many, is ordinary.
COMMON_SHARE, COMMON_TEXTS = 0.005, 20
#: Score from which a text counts as a case.
THRESHOLD = 0.5

_ENDS = regex.compile(r"[\p{Sentence_Terminal}\n\r\v\f\x85  --.]", regex.V1)
_KEPT = regex.compile(r"[\p{L}\p{M}\p{N}]")
_DROPPED = regex.compile(r"[\p{Cf}\p{Cc}\p{Co}\p{Cs}\p{So}\p{Sk}̀-ًͯ-ٰٟـ]")
_SOLID = re.compile("[ก-໿က-႟ក-៿぀-ヿ㐀-鿿\U00020000-\U0003ffff]")
_PLAIN = {"ى": "ي", "ة": "ه", "ё": "е", "@": "a", "$": "s", "…": ".", ".": ".", "-": "-", "_": "_", "*": "*", "·": "·", "\t": " "}


class _Folds(dict):
    """What stands for each code point: folded letters, one mark for sentence ends, blanks for the rest."""

    def __missing__(self, point: int) -> str:
        ch = chr(point)
        if ch in _PLAIN:
            out = _PLAIN[ch]
        elif _ENDS.match(ch):
            out = "\n"
        elif _DROPPED.match(ch):
            out = ""
        else:
            parts = (_PLAIN.get(x, x) for x in unicodedata.normalize("NFKD", ch).lower() if not _DROPPED.match(x))
            out = "".join(x if _KEPT.match(x) or x in ".*" else " " for x in parts)
        self[point] = out
        return out


_FOLDS = _Folds()
_BLOCK = re.compile(r"<(?:/?(?:p|br|div|li|ul|ol|td|tr|table|h[1-6])\b[^<>]*|hr)>", re.I)
_TAG = re.compile(r"</?[a-zA-Z|!][^<>]*>")
_BROKEN = re.compile("(?:[Â-ô][\u0080-¿]{1,3})+")
_BREAKING = ("Ã", "Ø", "Ù", "Ð", "Ñ", "â\u0080")
_AGAIN = re.compile(r"([^\s\d])\1{2,}")
_STOP = re.compile(r"\.(?=\s|$)|(?<=[^\W\d_a-z])\.(?=[^\W\d_]{2})")
_LEET = re.compile(r"[013457]")
_DIGITS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"})
_FLAT = str.maketrans({".": " ", "-": " ", "_": " ", "·": " "})


def clean(text: str) -> str:
    """The text folded and without decoration; stretched letters and lines once; passages on lines."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", _BLOCK.sub("\n", text))
    if any(x in text for x in _BREAKING):
        text = _BROKEN.sub(" ", text)
    text = _AGAIN.sub(r"\1", text.translate(_FOLDS))
    return (_STOP.sub("\n", text) if "." in text else text).translate(_FLAT)


def _words(line: str) -> list[str]:
    words = line.split()
    if "*" in line:  # a star within a word hides a letter; around a word it is decoration, between all letters too
        words = [w.replace("*", "") if w[0] == "*" or w[1::2] == "*" * (len(w) // 2) and len(w) > 4 else w for w in words]
        words = [w for w in words if w]
    if list(map(len, words)).count(1) > 2:
        words = _joined(words)
    if _LEET.search(line):
        words = [w if w.isalpha() or w.isdecimal() else w.translate(_DIGITS) for w in words]
    return words


def _joined(words: list[str]) -> list[str]:
    """Three and more single letters in a row are one word, spelled out."""
    out: list[str] = []
    for single, run in groupby(words, key=lambda w: len(w) == 1 and w.isalpha()):
        same = list(run)
        out += ["".join(same)] if single and len(same) > 2 else same
    return out


def passages(text: str) -> list[list[str]]:
    """The words of each passage of a text."""
    return [p for line in clean(text).split("\n") for p in _windows(line)]


def _windows(line: str) -> list[list[str]]:
    """The words of a passage, in windows of bounded length that overlap by half.

    Where a script without blanks meets other words, each side is also a
    passage of its own; so is every piece of a very long word.
    """
    words = _words(line)
    if not words:
        return []
    runs = [words]
    if not line.isascii() and _SOLID.search(line):
        sides = [[w for w in words if bool(_SOLID.search(w)) == x] for x in (True, False)]
        if all(sides):
            runs += sides
    found: list[list[str]] = []
    for run in runs:
        if max(map(len, run)) > PIECE:
            for w in run:
                if len(w) > PIECE:
                    found += [[w[k : k + PIECE]] for k in range(0, len(w) - PIECE // 2, PIECE // 2)]
            run = [w for w in run if len(w) <= PIECE]
        if len(run) > WINDOW:
            found += [run[k : k + WINDOW] for k in range(0, len(run) - WINDOW // 2, WINDOW // 2)]
        elif run:
            found.append(run)
    return found


def pieces(word: str) -> list[str]:
    """The word itself and its character n-grams; numbers are one feature."""
    if word.isdecimal():
        return ["#"]
    if _SOLID.search(word):
        return [word[i : i + n] for n in (1, 2, 3, 4) for i in range(len(word) - n + 1)]
    edged = f"^{word}$"
    return [word, *(edged[i : i + n] for n in (3, 4, 5) for i in range(len(edged) - n + 1))]


def features(words: list[str]) -> list[str]:
    """All features of a passage, as often as they occur."""
    return [*(x for w in words for x in pieces(w)), *(f"{a} {b}" for a, b in zip(words, words[1:]))]


_SLOT = re.compile(r"\{(\w+)\}")


def _fill(template: str, rng: random.Random) -> str:
    """The template with a phrase in each slot; phrases may hold slots."""
    while _SLOT.search(template):
        template = _SLOT.sub(lambda m: rng.choice(SLOTS[m[1]]), template)
    return template


def _disguise(text: str, rng: random.Random) -> str:
    """The sentence with some of its words spelled to slip past a word list."""
    words = text.split(" ")
    for k in rng.sample(range(len(words)), min(len(words), rng.randint(1, 2))):
        w = words[k]
        if len(w) < 4 or not w.isalpha():
            continue
        at = rng.randrange(1, len(w) - 1)
        words[k] = rng.choice([
            w[:at] + "*" + w[at + 1 :],
            w[:at] + "**" + w[at + 2 :],
            w[: at + 1] + " " + w[at + 1 :],
            w[: at + 1] + w[at] + w[at + 1 :],
            "".join({"o": "0", "i": "1", "e": "3", "a": "@", "s": "$"}.get(c, c) for c in w),
        ])
    return " ".join(words)


def _swapped(template: str, rng: random.Random) -> tuple[str, str]:
    """Two fillings that differ in the groups alone."""
    a = b = template
    for slot in re.findall(r"\{(\w*group)\}", template):
        x, y = rng.sample(SLOTS[slot], 2)
        a, b = a.replace(f"{{{slot}}}", x, 1), b.replace(f"{{{slot}}}", y, 1)
    seed = rng.random()
    return _fill(a, random.Random(seed)), _fill(b, random.Random(seed))


class Model:
    """Weights by feature, and the bias.

    Words met are numbered, with what each adds to a sum; pairs of words are
    found by their numbers. So a batch of texts is scored by a few array
    operations, after one look-up for each word.
    """

    #: Words a worker keeps.
    KEPT_WORDS = 500_000
    #: Passages a worker keeps the scores of.
    KEPT_LINES = 100_000

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self._start()

    def _start(self) -> None:
        pairs = [(*x.split(" "), v) for x, v in self.weights.items() if " " in x]
        self.paired = {w: k for k, w in enumerate(sorted({w for a, b, _ in pairs for w in (a, b)}))}
        width = len(self.paired) + 1
        keys = np.array([self.paired[a] * width + self.paired[b] for a, b, _ in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.width, self.keys, self.values = width, keys[order], np.array([v for *_, v in pairs], dtype=float)[order]
        self.lines: dict[str, float] = {}
        self.number: dict[str, int] = {}
        self.sums: list[float] = []
        self.sizes: list[int] = []
        self.places: list[int] = []

    def __getstate__(self) -> tuple[dict[str, float], float]:
        return self.weights, self.bias

    def __setstate__(self, state: tuple[dict[str, float], float]) -> None:
        self.weights, self.bias = state
        self._start()

    def _add(self, word: str) -> int:
        p = pieces(word)
        get = self.weights.get
        self.sums.append(sum(get(x, 0.0) for x in p))
        self.sizes.append(len(p))
        self.places.append(self.paired.get(word, -1))
        self.number[word] = n = len(self.sums) - 1
        return n

    def scores(self, found: list[list[str]]) -> np.ndarray:
        """The score of each passage: the bias and the weights over the root of the number of features."""
        if not found:
            return np.empty(0)
        if len(self.number) > self.KEPT_WORDS:
            self._start()
        number, add = self.number, self._add
        ids = np.array([number[w] if w in number else add(w) for p in found for w in p], dtype=np.int64)
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        total = np.add.reduceat(np.array(self.sums)[ids], starts)
        n = np.add.reduceat(np.array(self.sizes)[ids], starts) + lengths - 1
        if len(self.keys) and len(ids) > 1:
            place = np.array(self.places)[ids]
            key = place[:-1] * self.width + place[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            inner = np.ones(len(ids) - 1, dtype=bool)
            inner[starts[1:] - 1] = False
            hit = (self.keys[at] == key) & (place[:-1] >= 0) & (place[1:] >= 0) & inner
            total += np.add.reduceat(np.r_[np.where(hit, self.values[at], 0.0), 0.0], starts)
        return self.bias + total / np.sqrt(np.maximum(1, n))

    def score(self, words: list[str]) -> float:
        return float(self.scores([words])[0])

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """The highest probability of a passage of each text; 0 where there is none.

        Passages that come again, as boilerplate does, are scored once.
        """
        each = [clean(t).split("\n") if t else [] for t in texts]
        if len(self.lines) > self.KEPT_LINES:
            self.lines.clear()
        known = self.lines
        new = list(dict.fromkeys(x for lines in each for x in lines if x not in known))
        found = [_windows(x) for x in new]
        tops = np.full(len(new), -np.inf)
        some = np.array([k for k, p in enumerate(found) if p], dtype=np.int64)
        if len(some):
            sizes = np.array([len(found[k]) for k in some])
            tops[some] = np.maximum.reduceat(self.scores([p for ps in found for p in ps]), np.r_[0, np.cumsum(sizes)[:-1]])
        known.update(zip(new, tops.tolist()))
        top = np.array([max([known[x] for x in lines]) if lines else -np.inf for lines in each])
        return np.where(np.isneginf(top), 0.0, 1 / (1 + np.exp(-np.clip(top, -50, 50))))

    def probability(self, text: str | None) -> float:
        return float(self.probabilities([text])[0])


def samples(copies: int = COPIES, seed: int = 11) -> tuple[list[str], np.ndarray, list[tuple[int, int]]]:
    """Sentences, labels and the index pairs of counterfactual copies."""
    rng = random.Random(seed)
    texts: list[str] = []
    labels: list[float] = []
    twins: list[tuple[int, int]] = []
    neutral = [t for t in NEUTRAL.strip().split("\n") if t]
    for label, templates in ((1.0, ABUSIVE.strip().split("\n")), (0.0, neutral)):
        for t in templates:
            for k in range(copies):
                if k % 2 and "group}" in t:
                    a, b = _swapped(t, rng)
                    twins.append((len(texts), len(texts) + 1))
                    texts += [a, b]
                    labels += [label, label]
                    continue
                text = _fill(t, rng)
                if k % 4 == 1:
                    text = _disguise(text, rng)
                elif k % 4 == 2:
                    text = f"{text}, {_fill(rng.choice(neutral), rng)}"
                elif k % 4 == 3:
                    text = f"{_fill(rng.choice(neutral), rng)}, {text}"
                texts.append(text)
                labels.append(label)
    return texts, np.array(labels), twins


class _Rows:
    """Bags of features as sparse rows; features that only one row has are left out."""

    def __init__(self, bags: list[list[str]]):
        index: dict[str, int] = {}
        cols = np.array([index.setdefault(x, len(index)) for f in bags for x in f], dtype=np.int64)
        size = np.array(list(map(len, bags)), dtype=np.int64)
        key, k = np.unique(np.repeat(np.arange(len(bags)), size) * max(1, len(index)) + cols, return_counts=True)
        r, c = key // max(1, len(index)), key % max(1, len(index))
        shared = np.bincount(c, minlength=len(index)) > 1
        at = np.cumsum(shared) - 1
        self.names = [x for x, y in zip(index, shared) if y]
        kept = shared[c]
        self.r, self.c = r[kept], at[c[kept]]
        self.v = (k / np.sqrt(np.maximum(1, size))[r])[kept]
        self.n = len(bags)

    def solve(self, labels: np.ndarray, weights: np.ndarray, twins: tuple[np.ndarray, np.ndarray], swap_penalty: float, ridge: float, rounds: int, start: np.ndarray) -> np.ndarray:
        """Weights and, last, the bias that make the weighted loss small, by full-batch Adam; rows of weight 0 don't count."""
        used = weights[self.r] > 0
        r, c, v = self.r[used], self.c[used], self.v[used]
        rows, begin = np.unique(r, return_index=True)
        a, b = twins
        w, m, s = start.copy(), np.zeros(len(start)), np.zeros(len(start))
        for step in range(1, rounds + 1):
            z = np.full(self.n, w[-1])
            z[rows] += np.add.reduceat(v * w[c], begin) if len(begin) else 0
            g = weights * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels)
            if len(a):
                gap = swap_penalty * 2 * (z[a] - z[b]) / len(a)
                np.add.at(g, a, gap)
                np.add.at(g, b, -gap)
            grad = np.append(np.bincount(c, v * g[r], minlength=len(w) - 1) + ridge * w[:-1], g.sum())
            m = 0.9 * m + 0.1 * grad
            s = 0.999 * s + 0.001 * grad * grad
            w -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-9)
        return w

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.r, self.v * w[self.c], minlength=self.n) + w[-1]


def fit(
    texts: list[str],
    labels: np.ndarray,
    twins: list[tuple[int, int]],
    background: list[str] | None = None,
    swap_penalty: float = 0.5,
    ridge: float = 5e-6,
    rounds: int = 100,
    dubious: tuple[float, ...] = (0.02, 0.01, 0.007),
) -> Model:
    """Logistic regression with squared score differences of twins as a penalty.

    Loss: weighted log loss, plus ``swap_penalty`` times the mean squared
    difference of the twins' scores, plus ``ridge`` times half the squared
    weights. On a bounded sample, so on the driver.

    ``background`` are unlabelled texts of the corpus to be scored. Nearly all
    their passages are ordinary, so they join as such, each with the number of
    texts it stands in; but the highest-scored share ``dubious`` of them is left
    out, as it may be abuse, in turns with the fit. What stands in over
    COMMON_SHARE of the texts (and over COMMON_TEXTS) is never left out.
    """
    passages_of = [tuple(tuple(p) for p in passages(t)) for t in background or ()]
    met: Counter = Counter(p for ps in passages_of for p in set(ps))
    common = max(COMMON_TEXTS, COMMON_SHARE * len(passages_of))
    counts = np.array(list(met.values()), dtype=float)
    rows = _Rows([features([w for p in passages(t) for w in p]) for t in texts] + [features(list(p)) for p in met])
    pair = tuple(np.array(x, dtype=int) for x in zip(*twins)) if twins else (np.empty(0, int), np.empty(0, int))
    positive = labels > 0
    y = np.r_[labels, np.zeros(len(counts))]
    share = lambda yes, no: np.where(positive, yes / max(1, positive.sum()), no / max(1, (~positive).sum()))
    w = rows.solve(y, np.r_[share(0.5, 0.5), np.zeros(len(counts))], pair, swap_penalty, ridge, rounds, np.zeros(len(rows.names) + 1))
    if len(counts):
        doubtful = np.where(counts > common, 0.0, counts)
        for left_out in dubious:
            order = np.argsort(-rows.scores(w)[len(texts) :], kind="stable")
            drop = order[np.cumsum(doubtful[order]) < left_out * counts.sum()]
            own = counts.copy()
            own[drop[doubtful[drop] > 0]] = 0
            w = rows.solve(y, np.r_[share(0.3, 0.2), 0.5 * own / max(1.0, own.sum())], pair, swap_penalty, ridge, rounds // 2, w)
    keep = np.abs(w[:-1]) > 1e-4
    return Model({x: float(v) for x, v, k in zip(rows.names, w, keep) if k}, float(w[-1]))


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model of the labelled sample alone."""
    return fit(*samples())


_ADAPTED: dict[str, Model] = {}


def adapted(df: DataFrame, text: str = "text", texts: int = BACKGROUND, chars: int = BACKGROUND_CHARS) -> Model:
    """The model of the labelled sample and of ``texts`` whole texts of the corpus, without labels.

    The texts are different ones, chosen by their hash, as many as have
    ``chars`` characters together, so that the sample fits the driver and is
    the same in every run and partitioning and no text that is repeated very
    often fills it. One scan; about twice as many are kept until
    repeats are dropped. Of an empty table this is :func:`trained`.
    """
    rows = df.select(F.col(f"`{text}`").cast("string").alias("t")).where("t <> ''").withColumn("h", F.xxhash64("t"))
    part = min(1.0, 2 * texts / max(1, df.count()))
    rows = rows.where(F.pmod("h", F.lit(1 << 31)) < int(part * (1 << 31))).dropDuplicates(["h"]) if part < 1 else rows.dropDuplicates(["h"])
    rows = cut(rows)
    sizes = rows.select("h", F.length("t").alias("n")).orderBy("h").limit(texts).collect()
    chosen, room = [], chars
    for r in sizes:
        if r.n <= room:
            chosen.append(r.h)
            room -= r.n
    sample = sorted(r.t for r in rows.where(F.col("h").isin(chosen)).collect()) if chosen else []
    if not sample:
        return trained()
    key = hashlib.sha256("\0".join(sample).encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _ADAPTED:
        if len(_ADAPTED) > 3:
            _ADAPTED.clear()
        _ADAPTED[key] = fit(*samples(), background=sample)
    return _ADAPTED[key]


def score(df: DataFrame, text: str = "text", out: str = "score", model: Model | None = None) -> DataFrame:
    """df with the probability that its text holds such a passage, in ``out``.

    The score is that of the worst passage, whatever the text's length. Null,
    empty and blank texts score 0. Repeated rows are kept, as are all columns,
    but one named ``out``, which is replaced. An empty table gives an empty
    result. No shuffle; the model broadcast has one weight for each feature of
    the bounded labelled sample.
    """
    bound = df.sparkSession.sparkContext.broadcast(model or trained())

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(bound.value.probabilities(texts.tolist()), dtype=float)

    return df.withColumn(out, run(F.col(f"`{text}`").cast("string")))


def source_rates(scored: DataFrame, source: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """n_docs, n_flagged and rate of each source; a null source is a group."""
    flagged = F.col("score") >= threshold
    return scored.groupBy(source).agg(F.count("*").alias("n_docs"), F.count_if(flagged).alias("n_flagged"), F.avg(flagged.cast("double")).alias("rate"))

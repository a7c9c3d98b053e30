"""Sentence boundaries across languages and scripts, learned without labels.

A first pass counts, per language and over all texts: words, words with a
period and what follows them, words that begin lines or follow an unambiguous
end mark, and words after a closed quotation. Log-likelihood ratios of these
counts give abbreviations, collocations (abbreviation and number or name) and
frequent sentence starters. The second pass classifies every period, ellipsis,
closing quotation and, in Thai and Lao, every blank with these statistics.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.session import cut, scratch_path

#: Rows of a model that is kept in memory; a larger one is kept in a file.
MODEL_ROWS = 1_000_000
#: Texts a worker keeps the sentences of.
KEPT_TEXTS = 20_000
#: Distinct keys a worker counts before it passes partial counts on.
FLUSH_KEYS = 200_000

_LINE = regex.compile(r"[\n\r\v\f\x85\u2028\u2029]+")
_BULLET = r"[\s\p{Cf}]*(?:[-*–—•·▪‣◦+#][\s\p{Cf}]+)?(?:[\s\p{Cf}]*[(\[]?\p{Nd}{1,3}[.)\]][\s\p{Cf}]+)?"
_CLOSE = "\"'”’»›)\\]}」』】）》*_"
#: Unicode's Sentence_Terminal without periods and the Burmese comma, with the Tibetan marks and the Greek question mark.
_PERIODS = ".．…‥․"
_FIRM = "".join(c for c in map(chr, [*range(0x2FFF), *range(0x3000, 0xD800), *range(0xE000, 0x20000)]) if regex.match(r"\p{Sentence_Terminal}", c) and c not in _PERIODS + "၊") + "\u0f0d\u0f0e\u037e"
_ENDS = _PERIODS[:3] + _FIRM
_EDGE = "\"'“”‘’«»‹›()[]{}「」『』（）,،;؛:!?؟*_—–-|=.…。！？۔।።\u200b\u200c\u200d\u200e\u200f\ufeff"
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_UNSPACED = regex.compile(r"[\p{Thai}\p{Lao}\p{Myanmar}\p{Khmer}]")
#: Frequent words by which languages of one script are told apart, and letters that only some have.
_FUNCTION_WORDS = {
    "Latin": {
        "en": "the and of to in is for with that on are you we by from this have at will be our not your",
        "fr": "le la les des une est et pour du dans que avec sur au aux en nous vous par qui pas son",
        "es": "el la los las de y que en un una es por con para del se su al como más no está",
        "de": "der die das und ist nicht mit ein eine für von zu auf den im wir sie des dem werden auch",
        "it": "il di che e la un una per non con sono del della le gli i da nel alla è anche più",
        "pt": "o a os as de e que em um uma para com não do da no na por se mais são é",
        "nl": "de het een en van is dat niet op te voor met zijn aan bij ook wij naar worden uit",
        "tr": "ve bir bu için ile da de çok olan var olarak gibi daha en mi değil kadar sonra",
        "pl": "i w na z do się nie jest że to o po dla przez od jak są oraz za przy",
        "id": "yang dan di untuk dengan dari ini itu pada tidak akan adalah dalam ke oleh kami atau",
        "sv": "och att det som en på är av för med den till inte om har vi ett från var",
        "vi": "và của là có trong cho không được với một người các này đã để khi những",
    },
    "Cyrillic": {
        "ru": "и в на не что с по для от как это к из у мы за или при о вы",
        "uk": "і в на не що з для від як це до та у ми за або при є й про",
        "bg": "и на за се от да не с по е са че като в ще към или до при това",
        "sr": "и у на за се од да не са је су као или до при то који који су",
    },
    "Devanagari": {
        "hi": "के का की है में और को से पर नहीं एक यह हैं कि भी था ने लिए",
        "mr": "आणि आहे या च्या मध्ये ते हे आहेत एक नाही साठी पण असे होते",
        "ne": "र छ को मा लाई छन् भएको यो पनि गर्न हो तथा एक बाट",
    },
}
#: Letters that speak for a language where function words are few.
_HINTS = {"fr": "éèêàçùœ", "es": "ñ¿¡", "de": "äß", "pt": "ãõ", "tr": "şğı", "pl": "łąęśź", "sv": "å", "vi": "đơưạ", "uk": "іїє", "bg": "ъ", "sr": "јљњћ"}
_ONLY = {"ur": regex.compile(r"[ںہےٹڈڑھ۔]"), "fa": regex.compile(r"[گچپژ]|\bمی")}
_BY_WORD = {script: {w: [k for k, v in by.items() if w in v.split()] for x in by.values() for w in x.split()} for script, by in _FUNCTION_WORDS.items()}
_SCRIPTS = [(n, regex.compile(rf"\p{{{n}}}+")) for n in ("Latin", "Arabic", "Cyrillic", "Devanagari", "Ethiopic", "Hebrew", "Greek", "Armenian", "Hangul", "Bengali", "Thai", "Lao", "Myanmar", "Khmer", "Tibetan", "Tamil", "Telugu", "Gujarati", "Georgian")]
_CASED = {*_FUNCTION_WORDS["Latin"], *_FUNCTION_WORDS["Cyrillic"], "Greek", "Armenian"}
_RUNS = dict(_SCRIPTS)
_BLANKS = {"Thai", "Lao", "Myanmar", "Khmer"}  # scripts without blanks between words, but between sentences
_UP, _LOW = regex.compile(r"\p{Lu}+"), regex.compile(r"\p{Ll}+")
_CAP_WORD, _LOW_WORD = regex.compile(r"(?<!\p{L})\p{Lu}"), regex.compile(r"(?<!\p{L})\p{Ll}")
_MIXED = regex.compile(r"\p{Ll}\p{Lu}")
_WORD_CHAR = regex.compile(r"[\p{L}\p{N}]")


def _letters(runs: regex.Pattern, text: str) -> int:
    """How many characters all matches of a pattern have together."""
    return sum(map(len, runs.findall(text)))


def _by_words(text: str, script: str) -> str:
    """The script's language with the most function words in a text; the first where there are none."""
    known, found = _BY_WORD[script], Counter()
    for w in known.keys() & text.lower().split():
        found.update(known[w])
    names = list(_FUNCTION_WORDS[script])
    if not text.isascii():
        for lang in names:
            if any(c in text for c in _HINTS.get(lang, "")):
                found[lang] += 0.5
    return max(names, key=lambda k: (found[k], -names.index(k)))


def language(text: str) -> str:
    """A language or script: what the statistics are kept by.

    Scripts by counting letters, and languages of one script by their function
    words or letters. Languages not listed share statistics with another of
    their script.
    """
    if text.isascii():
        return _by_words(text, "Latin")
    if _UNSPACED.search(text):
        if len(_UNSPACED.findall(text)) * 4 > len(text):
            best = max(("Thai", "Lao", "Myanmar", "Khmer"), key=lambda k: _letters(_RUNS[k], text))
            return best
    if _CJK.search(text) and len(_CJK.findall(text)) * 5 > len(text):
        return "ja" if regex.search(r"[\p{Hiragana}\p{Katakana}]", text) else "zh"
    best, most = "Latin", -1
    for name, pattern in _SCRIPTS:
        if (n := _letters(pattern, text)) > most:
            best, most = name, n
        if n * 2 > len(text):
            break
    if best == "Arabic":
        return next((k for k, letters in _ONLY.items() if len(letters.findall(text)) * 30 > most), "ar")
    return _by_words(text, best) if best in _FUNCTION_WORDS else best


def regular_case(text: str) -> bool:
    """Whether capitals are used as in prose, not for all or none or at random."""
    up, low = _letters(_UP, text), _letters(_LOW, text)
    if not up or up * 5 > 2 * (up + low):
        return False
    if len(_MIXED.findall(text)) > 3 + low * 0.01:
        return False
    return len(_CAP_WORD.findall(text)) < 2 * len(_LOW_WORD.findall(text))


_ITEM = regex.compile(_BULLET)
_AFTER_FIRM = regex.compile(rf"[{_FIRM}]+[^\S\n]+(\S+)")
_AFTER_QUOTE = regex.compile(rf"[{_ENDS}][{_CLOSE}]+[^\S\n]*([^\s{_CLOSE}{_ENDS},،、，;]\S*)")
_CJK_STARTS = regex.compile(r"(?:^|[\n\r]|[。！？])\s*(\p{L}{2})")
_CJK_CLAUSES = regex.compile(r"(?:^|[\n\r]|[。！？，、；：…])\s*(\p{L}{2})")


def _prefix(chunk: str) -> str:
    """What stands for a chunk of unspaced script: its first letters."""
    chunk = chunk.strip(_EDGE)
    return chunk[:4] if _UNSPACED.match(chunk) else ""


class Counts:
    """Counts of one worker, by (language, kind, a, b).

    Kinds: T words (of regular case: capitalised ones apart, as U), P words
    with a period and what follows, S starts, C continuers of quotations.
    """

    def __init__(self) -> None:
        self.raw: defaultdict[tuple[str, str], Counter] = defaultdict(Counter)  # by (language, kind)

    def __len__(self) -> int:
        return sum(map(len, self.raw.values()))

    def add(self, text: str) -> None:
        lang = language(text)
        if lang in ("zh", "ja"):
            self.raw[lang, "S"].update(_CJK_STARTS.findall(text))
            self.raw[lang, "T"].update(_CJK_CLAUSES.findall(text))
            self.raw[lang, "C"].update(w[:2] for w in _AFTER_QUOTE.findall(text))
            return
        lines = [words for x in _LINE.split(text) if (words := x.split())]
        if lang in _BLANKS:
            starts, chunks = self.raw[lang, "S"], self.raw[lang, "T"]
            starts.update(_prefix(words[0]) for words in lines)
            starts.update(map(_prefix, _AFTER_FIRM.findall(text)))
            for words in lines:
                chunks.update(map(_prefix, words))
            starts.pop("", None)
            return
        kind = "r" if lang not in _CASED or regular_case(text) else "x"
        seen, periods = self.raw[lang, "T" + kind], self.raw[lang, "P" + kind]
        for words in lines:
            seen.update(words)
            last = len(words) - 1
            periods.update((w[:-1], words[k + 1] if k < last else "") for k, w in enumerate(words) if w[-1] == "." and len(w) > 1)
        if kind == "r":
            firsts = self.raw[lang, "S"]
            firsts.update(rest[0] for x in _LINE.split(text) if (rest := x[_ITEM.match(x).end() :].split(None, 1)))
            firsts.update(_AFTER_FIRM.findall(text))
            self.raw[lang, "C"].update(_AFTER_QUOTE.findall(text))

    def _items(self) -> Iterator[tuple[str, str, str, str, int]]:
        for (lang, kind), counter in self.raw.items():
            for key, n in counter.items():
                a, b = key if kind[0] == "P" else (key, "")
                yield lang, kind, a, b, n

    def flush(self) -> pd.DataFrame:
        """The counts so far with words stripped and folded; starts anew."""
        done: Counter = Counter()
        for lang, kind, a, b, n in self._items():
            if lang in ("zh", "ja", *_BLANKS):
                done[lang, kind, a, b] += n
                continue
            cased = lang in _CASED
            w = a.strip(_EDGE)
            if kind[0] == "T":
                if not w or not _WORD_CHAR.search(w) or w[0].isdecimal():
                    continue
                if not a.endswith("."):
                    done[lang, "T", w.casefold(), ""] += n
                if kind == "Tr" and (not cased or w[0].isupper()):
                    done[lang, "U", w.casefold(), ""] += n
            elif kind[0] == "P":
                if not w or a.endswith((".", "…")) or any(ch.isdecimal() for ch in w):
                    continue
                after = b.strip(_EDGE)
                if not b:
                    what = "end"
                elif not after or after[0].isdecimal():
                    what = "number"
                elif cased and kind == "Px":
                    what = "word:" + after.casefold()
                elif cased and after[0].islower():
                    what = "lower:" + after
                else:
                    what = "word:" + after.casefold()
                done[lang, "P", w.casefold(), what] += n
            elif w and not w[0].isdecimal() and _WORD_CHAR.match(w):
                if kind == "S" and (not cased or w[0].isupper()):
                    done[lang, "S", w.casefold(), ""] += n
                elif kind == "C" and (not cased or w[0].islower()):
                    done[lang, "C", w.casefold(), ""] += n
        self.raw.clear()
        rows = [(*k, n) for k, n in done.items()]
        return pd.DataFrame(rows, columns=["lang", "kind", "a", "b", "n"])


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = Counts()
    for batch in batches:
        for k, text in enumerate(batch["text"]):
            if text:
                counts.add(text)
            if k % 100 == 0 and len(counts) > FLUSH_KEYS:
                yield counts.flush()
    yield counts.flush()


class Model:
    """What was learned, by (kind, language, word): None, or the row's flag.

    Kinds: S starters; A abbreviations, flag: may end a sentence before a name;
    C continuers, flag: hardly ever begins a sentence; L collocations, the word
    being a word with period, a tab and the next word.
    """

    def __init__(self, rows: Iterable[tuple[str, str, str, bool]] = ()):
        self.rows = {(kind, lang, a): flag for lang, kind, a, flag in rows}

    def get(self, kind: str, lang: str, word: str) -> bool | None:
        return self.rows.get((kind, lang, word))


class StoredModel(Model):
    """A model of any size: sorted 64-bit hashes of the rows in a file that all workers of a machine map."""

    def __init__(self, path: str):
        self.path, self.keys = path, None

    def __getstate__(self) -> str:
        return self.path

    def __setstate__(self, path: str) -> None:
        self.path, self.keys = path, None

    @staticmethod
    def key(kind: str, lang: str, word: str) -> int:
        """63 bits of a hash; the lowest bit of a stored key is the flag."""
        return int.from_bytes(hashlib.blake2b(f"{kind}\t{lang}\t{word}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") & ~1

    def get(self, kind: str, lang: str, word: str) -> bool | None:
        if self.keys is None:
            self.keys = np.memmap(self.path, dtype=np.uint64, mode="r")
        key = self.key(kind, lang, word)
        at = int(np.searchsorted(self.keys, np.uint64(key)))
        if at < len(self.keys) and int(self.keys[at]) & ~1 == key:
            return bool(int(self.keys[at]) & 1)
        return None

    @classmethod
    def write(cls, rows: DataFrame) -> StoredModel:
        """Hash and sort the rows on the executors, and write them one part after another to the shared folder."""

        @F.pandas_udf("decimal(20,0)")
        def hashed(kind: pd.Series, lang: pd.Series, a: pd.Series, flag: pd.Series) -> pd.Series:
            return pd.Series([Decimal(cls.key(*x) | int(f)) for *x, f in zip(kind, lang, a, flag)], dtype=object)

        spark = rows.sparkSession
        path = scratch_path(spark, "sentence-model").removeprefix("file://").removeprefix("file:")
        if "://" in path:
            raise ValueError("a sentence model this large needs a checkpoint folder that is mounted on all machines")
        keys = rows.select(hashed("kind", "lang", "a", "flag").alias("k")).distinct().orderBy("k")
        with open(path, "wb") as f:
            for r in keys.toLocalIterator():
                f.write(int(r.k).to_bytes(8, sys.byteorder))
        return cls(path)


def _ll(k: Column, n: Column, p: Column) -> Column:
    """log likelihood of k successes of n at rate p, with the rate kept off 0 and 1."""
    p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), p))
    return k * F.log(p) + (n - k) * F.log(1 - p)


#: Log-likelihood ratio from which an association counts (p = 0.005).
SIGNIFICANT = 7.88


def _ratio(k: Column, n: Column, k_all: Column, n_all: Column) -> Column:
    """Dunning's ratio: k of n here against k_all of n_all, here included."""
    base = k_all / F.greatest(n_all, k_all, F.lit(1))
    return 2 * (_ll(k, n, k / F.greatest(n, F.lit(1))) - _ll(k, n, base))


def _often(s: Column, u: Column, all_s: Column, all_u: Column) -> Column:
    """Whether a word begins sentences significantly and more than twice as often as others do."""
    base = all_s / F.greatest(all_u, all_s, F.lit(1))
    return (s / F.greatest(u, F.lit(1)) > F.least(F.lit(0.5), 2 * base)) & (_ratio(s, u, all_s, all_u) > SIGNIFICANT)


def statistics(texts: DataFrame) -> DataFrame:
    """The model's rows (lang, kind, a, flag) from all texts (column text).

    All decisions are by Dunning's log-likelihood ratio, of 7.88 or more
    (p = 0.005), and the direction of the association. Starters: words whose
    share of starts (of lines, after sure end marks and after periods of other
    words than abbreviations) is over twice the language's; in scripts without
    blanks between words, beginnings of chunks or clauses that are starts more
    often than there on average. Abbreviations: the ratio of the word's periods
    against the language's, scaled for length, inner periods and uses without
    period, and mostly followed by what can't start a sentence; or words whose
    periods are followed by numbers and small letters mostly and more than
    others'. Continuers: words after a quotation that go on with its sentence.
    Collocations: pairs of a word with period and a small next word that follows
    it more often than it follows other periods.

    Sides with a row for each language are broadcast; the others are joined
    with the language and the word as key.
    """
    c = texts.select("text").mapInPandas(_count, "lang string, kind string, a string, b string, n bigint")
    c = cut(c.groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n")))
    some = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    one = F.broadcast
    # starts s, capitalised uses u, uses without period t, uses after quotations q of each word
    words = c.where("kind <> 'P'").groupBy("lang", "a").agg(*[some(F.col("kind") == k).alias(n) for k, n in (("S", "s"), ("U", "u"), ("T", "t"), ("C", "q"))])
    words = cut(words)
    totals = one(words.groupBy("lang").agg(F.sum("s").alias("all_s"), F.sum("u").alias("all_u"), F.sum("t").alias("all_t")))
    unspaced = F.col("lang").isin("zh", "ja", *_BLANKS)
    follow = c.where("kind = 'P'").withColumn("next", F.when(F.col("b").startswith("word:"), F.expr("substring(b, 6)")))
    after = follow.where("next IS NOT NULL").groupBy("lang", F.col("next").alias("a")).agg(F.sum("n").alias("after"), F.count("*").alias("befores"))
    seen = words.join(after, ["lang", "a"], "full").fillna(0, ["s", "u", "t", "q", "after", "befores"]).where("s > 0 OR after > 0")
    uses = F.when(unspaced | (F.col("u") == 0), F.col("t")).otherwise(F.col("u"))
    seen = seen.withColumn("u", F.greatest("s", uses)).join(totals, "lang", "left")
    seen = cut(seen.withColumn("all_s", F.coalesce("all_s", F.lit(0))).withColumn("all_u", F.when(unspaced, F.greatest("all_t", "all_s")).otherwise(F.greatest(F.coalesce("all_u", F.lit(0)), "all_s"))))
    # what only ever follows sure ends and periods may begin sentences: a capital proves
    # little there; without capitals the periods of many words must precede it
    cased = F.col("lang").isin(*_CASED)
    enough = F.when(cased, (F.length("a") > 1) & (F.col("s") > 0) & (F.col("u") >= 5)).otherwise(F.col("befores") >= 5)
    likely = enough & (F.col("s") + F.col("after") >= 0.9 * F.col("u"))
    marks = seen.where(~unspaced & (likely | _often(F.col("s"), F.col("u"), F.col("all_s"), F.col("all_u")))).select("lang", F.col("a").alias("next"), F.lit(1).alias("st"))
    follow = follow.join(marks, ["lang", "next"], "left")
    per = follow.groupBy("lang", "a").agg(
        F.sum("n").alias("p"),
        some(F.col("b") == "end").alias("end"),
        some((F.col("b") == "number") | F.col("b").startswith("lower:")).alias("inner"),
        some(F.col("next").isNotNull() & F.col("st").isNull()).alias("name"),
    )
    per = cut(per)
    sums = one(per.groupBy("lang").agg(F.sum("p").alias("all_p"), F.sum("inner").alias("all_inner")))
    per = per.join(words.select("lang", "a", "t"), ["lang", "a"], "left").fillna({"t": 0}).join(sums, "lang").join(totals.select("lang", "all_t"), "lang", "left")
    rate = F.col("all_p") / (F.col("all_p") + F.coalesce("all_t", F.lit(0)) + 1)
    n = F.col("p") + F.col("t")
    dunning = 2 * (_ll(F.col("p"), n, F.lit(0.99)) - _ll(F.col("p"), n, rate))
    letters = F.length(F.regexp_replace("a", r"\.", ""))
    inner = F.length("a") - letters
    # uses without period count as a share, so that the penalty doesn't grow with the corpus
    log_score = F.log(F.greatest(dunning, F.lit(1e-300))) - letters + F.log(inner + 1.0) - 12 * F.col("t") / n * F.log(letters + 1.0)
    internal = (F.col("inner") + F.col("name")) / F.col("p")
    inside = F.col("inner") / F.greatest(F.col("p"), F.lit(1))
    mostly = (inside > 0.5) & (_ratio(F.col("inner"), F.col("p"), F.col("all_inner"), F.col("all_p")) > SIGNIFICANT) & (F.col("t") < F.col("p"))
    found = ((log_score > math.log(0.3)) & (internal > 0.4)) | mostly
    abbreviations = cut(per.where(found).select("lang", F.lit("A").alias("kind"), "a", (F.col("end") > F.col("name")).alias("flag")))
    # starters again, with what follows the periods of other words
    ended = follow.where("next IS NOT NULL").join(abbreviations.select("lang", "a"), ["lang", "a"], "left_anti")
    ended = ended.groupBy("lang", F.col("next").alias("a")).agg(F.sum("n").alias("s2"))
    seen = seen.join(ended, ["lang", "a"], "left").withColumn("s2", F.col("s") + F.coalesce("s2", F.lit(0)))
    seen = seen.withColumn("u", F.greatest("u", "s2"))
    seen = seen.join(one(seen.groupBy("lang").agg(F.sum("s2").alias("all_s2"))), "lang")
    share, base = F.col("s") / F.col("u"), F.col("all_s") / F.col("all_u")
    above = (share > base) & (_ratio(F.col("s"), F.col("u"), F.col("all_s"), F.col("all_u")) > SIGNIFICANT)
    is_start = F.when(unspaced, above).otherwise(_often(F.col("s2"), F.col("u"), F.col("all_s2"), F.col("all_u")))
    starters = seen.where(is_start).select("lang", F.lit("S").alias("kind"), "a", F.lit(False).alias("flag"))
    seldom = F.col("s") + 1 < 0.25 * F.col("q")
    continuers = words.where((F.col("q") > 0) & ((F.col("q") >= 2) | seldom)).select("lang", F.lit("C").alias("kind"), "a", seldom.alias("flag"))
    # words that go on after a period of a word that is no abbreviation in general
    low = follow.where("b LIKE 'lower:%'").select("lang", "a", F.expr("substring(b, 7)").alias("w"), "n")
    after_any = low.groupBy("lang", "w").agg(F.sum("n").alias("w_p"))
    low = low.join(abbreviations.select("lang", "a"), ["lang", "a"], "left_anti").join(after_any, ["lang", "w"]).join(per.select("lang", "a", "p", "all_p"), ["lang", "a"])
    together = (F.col("n") / F.col("p") > F.col("w_p") / F.col("all_p")) & (_ratio(F.col("n"), F.col("p"), F.col("w_p"), F.col("all_p")) > SIGNIFICANT)
    together = low.where(together).select("lang", F.lit("L").alias("kind"), F.concat_ws("\t", "a", "w").alias("a"), F.lit(False).alias("flag"))
    return starters.unionByName(abbreviations).unionByName(continuers).unionByName(together)


def learn(texts: DataFrame) -> Model:
    """The model of all texts: on the driver up to MODEL_ROWS rows, beyond that in a file."""
    rows = cut(statistics(texts))
    return Model(rows.collect()) if rows.count() <= MODEL_ROWS else StoredModel.write(rows)


_TERM = regex.compile(rf"[{_ENDS}]+")
_TERM_GREEK = regex.compile(rf"[{_ENDS};]+")
_TERM_THAI = regex.compile(rf"[{_ENDS}]+|[^\S\n\r]+")
_PAIRS = {"«": "»", "“": "”", "„": "“", "‹": "›", "「": "」", "『": "』", "(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "《": "》"}
_CLOSERS = {v: k for k, v in _PAIRS.items() if k != "„"}
_MARKS = regex.compile(r"''|[\"«»“”„‹›「」『』()\[\]{}（）【】《》]")
_BRACKETS = set("()[]{}（）")
_CLOSING = regex.compile(rf"(?:[\p{{Cf}}]*[{_CLOSE}]|(?<=\s)»)*")
_FRENCH_CLOSE = regex.compile(r"[^\S\n]»")
_LIST = regex.compile(r"[|;؛；]")
_LABEL = regex.compile(r"[\s\p{Cf}]*(?:[-*–•][\s\p{Cf}]+)?[^:=：]{1,40}[:=：]")
_URL = regex.compile(r"(?:https?://|www\.)\S+|[\w.+-]+@[\w-]+\.[\w.]+")
_NUMBER_ONLY = regex.compile(r"[\s\p{Cf}]*(?:[-*–—•·▪‣◦+#][\s\p{Cf}]*)?[(\[]?\p{Nd}{1,3}")


def _spans(line: str) -> list[tuple[int, int]]:
    """Half-open spans inside quotations and brackets, the closing mark included."""
    stack: list[tuple[str, int]] = []
    spans = []
    for m in _MARKS.finditer(line):
        ch, at = m[0], m.start()
        if ch in ('"', "''"):
            before, after = line[at - 1 : at], line[m.end() : m.end() + 1]
            if any(x == ch for x, _ in stack):
                while (top := stack.pop())[0] != ch:
                    pass
                spans.append((top[1], m.end()))
            elif before and not before.isspace() and before not in "([{«“:：=" and (not after or after.isspace() or after in ".,;!?،؛؟"):
                spans.append((0, m.end()))  # its opening mark was cut off
            else:
                stack.append((ch, at))
        elif ch in _PAIRS and not (ch == "“" and any(x == "„" for x, _ in stack)):
            stack.append((ch, at))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if _PAIRS.get(stack[k][0]) == ch:
                    spans.append((stack[k][1], m.end()))
                    del stack[k:]
                    break
            else:
                if ch not in _BRACKETS:
                    spans.append((0, m.end()))
    spans += [(at, len(line)) for ch, at in stack if ch not in _BRACKETS]
    return spans


def _is_list(line: str) -> bool:
    items = [i for i in _LIST.split(line) if i and not i.isspace()]
    if len(items) < 2:
        return False
    labelled = [bool((m := _LABEL.match(i)) and m[0].count(" ") < 9) for i in items]
    return sum(labelled) >= 2 and all(labelled[1:-1])


def _strip(text: str, begin: int, end: int) -> tuple[int, int]:
    while begin < end and text[begin].isspace():
        begin += 1
    while end > begin and text[end - 1].isspace():
        end -= 1
    return begin, end


def split(text: str | None, model: Model) -> list[tuple[int, int]]:
    """The sentences of a text as half-open code point spans."""
    if not text:
        return []
    lang = language(text)
    cased = lang in _CASED
    regular = not cased or regular_case(text)
    out: list[tuple[int, int]] = []
    at = 0
    for m in _LINE.finditer(text):
        if m.start() > at:
            _split_line(text, at, m.start(), lang, cased, regular, model, out)
        at = m.end()
    if at < len(text):
        _split_line(text, at, len(text), lang, cased, regular, model, out)
    return out


def _split_line(text: str, low: int, high: int, lang: str, cased: bool, regular: bool, model: Model, out: list) -> None:
    line = text[low:high]
    begin = 0

    def unit(end: int) -> None:
        nonlocal begin
        b, e = _strip(line, begin, end)
        if e > b and _WORD_CHAR.search(line, b, e):
            out.append((low + b, low + e))
        elif e > b and out and out[-1][1] > low:  # stray marks belong to the sentence before
            out[-1] = (out[-1][0], low + e)
        begin = end

    if _LIST.search(line) and _is_list(line):
        unit(len(line))
        return
    spans = _spans(line) if _MARKS.search(line) else []
    if "http" in line or "www." in line or "@" in line:
        spans += [m.span() for m in _URL.finditer(line)]
    term = _TERM_GREEK if lang == "Greek" else _TERM_THAI if lang in _BLANKS else _TERM
    for m in term.finditer(line):
        s, e = m.span()
        if s < begin:
            continue
        holder = None
        for a, b in spans:
            if a <= s < b and (holder is None or b > holder[1]):
                holder = (a, b)
        if m[0].isspace():
            if holder is None and model.get("S", lang, _prefix(line[e : e + 8].lstrip(_EDGE))) is not None and _WORD_CHAR.search(line, begin, s):
                unit(s)
            continue
        end = _CLOSING.match(line, e).end()
        if lang == "fr" and (q := _FRENCH_CLOSE.match(line, end)):
            end = q.end()
        if holder is not None:
            if end < holder[1]:
                continue
            if end >= len(line) or not _breaks_after_quote(line, end, not _WORD_CHAR.search(line, begin, holder[0]), lang, cased, regular, model):
                continue
            unit(end)
            continue
        if end < len(line) and _breaks(line, begin, s, e, end, m[0], lang, cased, regular, model):
            unit(end)
    unit(len(line))


_NEXT = regex.compile(r"[\s\p{Cf}]*([\"'“‘«‹(\[「『（„*_—–-]*)[\s\p{Cf}]*(\S*)")


def _following(line: str, end: int) -> tuple[str, str]:
    """The next word: as written without marks, and folded."""
    m = _NEXT.match(line, end)
    word = m[2].strip(_EDGE)
    return word, word.casefold()


def _breaks_after_quote(line: str, end: int, leads: bool, lang: str, cased: bool, regular: bool, model: Model) -> bool:
    """Whether a sentence ends with a quotation; ``leads`` if it began with it."""
    if lang in ("zh", "ja"):
        rest = line[end:].lstrip()
        if not rest or not _WORD_CHAR.match(rest):
            return rest[:1] in "「『“《（("
        return not model.get("C", lang, rest[:2])
    m = _NEXT.match(line, end)
    if line[end : end + 1] in (",", "،", ";", "؛", "，", "、") or m[1][:1] in ("—", "–", "-"):
        return False
    word, folded = _following(line, end)
    if not word:
        return False
    if cased and regular:
        return not word[0].islower()
    goes_on = model.get("C", lang, folded)
    return not goes_on and (goes_on is None or not leads)


def _breaks(line: str, begin: int, s: int, e: int, end: int, mark: str, lang: str, cased: bool, regular: bool, model: Model) -> bool:
    gap = end < len(line) and line[end].isspace()
    word, folded = _following(line, end)
    starter = model.get("S", lang, folded) is not None
    lower = cased and regular and word[:1].islower()
    if "…" in mark or mark.strip(".") == "" and len(mark) > 1:
        if lang in ("zh", "ja"):
            return model.get("S", lang, word[:2]) is not None
        return gap and starter and not lower
    if mark.strip(".．") != "":
        return not lower
    # single period
    if _NUMBER_ONLY.fullmatch(line, begin, s):
        return False
    p = s
    while p > begin and not line[p - 1].isspace():
        p -= 1
    left = line[p:s].strip(_EDGE)
    if not gap and end == e:
        return _joined(left, word, folded, starter, cased, regular, lang, model)
    if not word:
        return False
    if not gap:
        return not lower and line[end] not in ",،;؛:"
    key = left.casefold()
    known = model.get("A", lang, key)
    if known is None and cased and len(left) == 1 and left.isalpha() and (left.isupper() or not regular):
        known = False
    if known is None:
        return not lower and (not cased or regular or model.get("L", lang, f"{key}\t{folded}") is None)
    if len(left) == 1 and len(word) == 1:  # initials in a row
        return False
    if word[0].isdecimal() or lower:
        return False
    return starter or (known and (not cased or regular))


_PIECE = regex.compile(r"\p{L}[\p{L}\p{M}'’]*")


def _joined(left: str, word: str, folded: str, starter: bool, cased: bool, regular: bool, lang: str, model: Model) -> bool:
    """Whether a period without a blank after it ends a sentence."""
    first = _PIECE.match(word)
    if not first or not left or not left[-1].isalpha() and not left[-1] in ")٪%" and not left[-1].isdecimal() and not regex.match(r"\p{M}", left[-1]):
        return False
    if left[-1].isdecimal() and model.get("S", lang, first[0].casefold()) is None:
        return False
    last = left.rsplit(".", 1)[-1]
    if len(last) < 2 or model.get("A", lang, left.casefold()) is not None:
        return False
    if model.get("S", lang, first[0].casefold()) is not None:
        return not (cased and regular and word[0].islower())
    if not cased and not last.isascii():
        return len(first[0]) > 1  # no capitals to tell by, but neither are there names like node.js
    return cased and regular and len(last) > 2 and len(first[0]) > 2 and last[-1].islower() and word[0].isupper() and not word.isupper()


def sentences(df: DataFrame, keys: list[str], text: str, model: Model) -> DataFrame:
    """Distinct (keys..., char_start, char_end) of the sentences of column ``text``.

    Spans are 0-based, half-open and count code points of the text as it is. A
    line break always ends a unit; quotations and brackets aren't split
    inside; a list of labelled values on one line is one unit; bullets,
    numbers and closing marks belong to their sentence. Null, empty and blank
    texts have no sentence, marks alone make none. Repeated rows count once,
    an id with several texts has the sentences of each. Very long texts are
    read whole. Other columns are dropped. Empty tables give empty results.
    """
    bound = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[tuple[int, int]]] = {}  # texts that come again, as cues of one sentence do, are split once
        for batch in batches:
            if len(known) > KEPT_TEXTS:
                known.clear()
            texts = batch[text].tolist()
            found = [known[t] if t in known else known.setdefault(t, split(t, bound.value)) for t in texts]
            sizes = [len(f) for f in found]
            rows = batch[keys].loc[batch.index.repeat(sizes)].reset_index(drop=True)
            flat = [x for f in found for x in f]
            rows["char_start"] = pd.Series([a for a, _ in flat], dtype="int32")
            rows["char_end"] = pd.Series([b for _, b in flat], dtype="int32")
            yield rows

    rows = df.select(*keys, text).where(F.col(f"`{text}`").isNotNull())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    return rows.mapInPandas(run, f"{schema}, char_start int, char_end int").distinct()

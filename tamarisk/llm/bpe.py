"""Byte-level BPE of a whole corpus by batched numpy merge rounds.

The texts of a batch are split into words by the tokenizer's pattern; every
different word is one row of a single flat symbol array. A round looks up all
adjacent pairs at once by binary search in the sorted pair keys, finds each
word's lowest rank and merges that pair wherever it occurs in the word. Words
leave the array when no pair of theirs has a rank, so a round costs only what
is still open.
"""

from __future__ import annotations

import json
import os
from collections import ChainMap
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the pattern of public_tokenizers, with white space written out
#: as Unicode's White_Space (the regex module's \s differs on U+001C to U+001F).
_W = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_W}\p{{L}}\p{{N}}]+|[{_W}]+(?![^{_W}])|[{_W}]+"
)
_NONE = np.iinfo(np.int64).max


class ByteBPE:
    """A byte-level BPE vocabulary (tokenizers' JSON form)."""

    def __init__(self, path: str, cached_words: int = 200_000):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char_of = {b: chr(b) for b in printable}
        rest = (b for b in range(256) if b not in char_of)
        char_of |= {b: chr(256 + k) for k, b in enumerate(rest)}
        self.byte_ids = np.array([vocab[char_of[b]] for b in range(256)], dtype=np.int64)
        self.width = len(vocab) + 1
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        rows = [(vocab[a] * self.width + vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(pairs)]
        table = np.array(rows, dtype=np.int64)
        table = table[np.argsort(table[:, 0])]
        self.keys, self.ranks, self.merged = (np.ascontiguousarray(c) for c in table.T)
        self.pattern = regex.compile(PATTERN)
        self.cache: dict[str, np.ndarray] = {}
        self.sizes: dict[str, int] = {}
        self.cached_words = cached_words

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word, by merge rounds over all words together."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        out: list[np.ndarray] = [np.empty(0, dtype=np.int32)] * len(raw)
        sym = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        word = np.repeat(np.arange(len(raw)), lengths)
        while len(sym):
            key = sym[:-1] * self.width + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.where(known, self.ranks[at], _NONE)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, _NONE], starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            done = lowest == _NONE
            if done.any():
                for s, n in zip(starts[done], sizes[done]):
                    out[word[s]] = sym[s : s + n].astype(np.int32)
                if done.all():
                    break
            hit = (rank == np.repeat(lowest, sizes)[:-1]) & known
            # Of equal pairs that overlap (a a a) every second one merges, from the left.
            at_hit = np.flatnonzero(hit)
            follows = np.r_[False, np.diff(at_hit) == 1]
            if follows.any():
                order = np.arange(len(at_hit))
                first = np.maximum.accumulate(np.where(follows, 0, order))
                at_hit = at_hit[(order - first) % 2 == 0]
            sym[at_hit] = self.merged[at[at_hit]]
            keep = np.repeat(~done, sizes)
            keep[at_hit + 1] = False
            sym, word = sym[keep], word[keep]
        return out

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null and empty texts have none."""
        split = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.cache) > self.cached_words:
            self.cache.clear()
        new = [w for w in dict.fromkeys(w for ws in split for w in ws) if w not in self.cache]
        fresh = dict(zip(new, self.encode_words(new)))
        long = {w: i for w, i in fresh.items() if len(w) > 64}
        self.cache.update((w, i) for w, i in fresh.items() if w not in long)
        known = ChainMap(self.cache, long) if long else self.cache
        empty = np.empty(0, dtype=np.int32)
        return [np.concatenate([known[w] for w in ws]) if ws else empty for ws in split]


    def count_batch(self, texts: list[str | None]) -> list[int]:
        """The number of ids of each text, without making them."""
        split = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.sizes) > self.cached_words:
            self.sizes.clear()
        new = [w for w in {w for ws in split for w in ws} if w not in self.sizes]
        fresh = dict(zip(new, map(len, self.encode_words(new))))
        long = {w: n for w, n in fresh.items() if len(w) > 64}
        self.sizes.update((w, n) for w, n in fresh.items() if w not in long)
        known = ChainMap(self.sizes, long) if long else self.sizes
        return [sum(map(known.__getitem__, ws)) for ws in split]

    @cached_property
    def token_bytes(self) -> list[bytes]:
        """The bytes of each id, from the merges."""
        out: list[bytes] = [b""] * (self.width - 1)
        for b, i in enumerate(self.byte_ids.tolist()):
            out[i] = bytes([b])
        order = np.argsort(self.ranks)
        for key, i in zip(self.keys[order].tolist(), self.merged[order].tolist()):
            out[i] = out[key // self.width] + out[key % self.width]
        return out

    def decode(self, ids: list[int]) -> bytes:
        known = self.token_bytes
        return b"".join(known[i] for i in ids)


@lru_cache(maxsize=4)
def load(path: str) -> ByteBPE:
    """The vocabulary, once per worker process: from its path, else as the driver shipped it."""
    return ByteBPE(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))


def _shipped(path: str) -> str:
    """The path, its file also sent along for executors that don't have it there."""
    SparkSession.active().sparkContext.addFile(path)
    return path


def _slices(texts: pd.Series, chars: int) -> Iterator[slice]:
    """Pieces of a batch of at most ``chars`` characters, or of one text."""
    begin, total = 0, 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if k > begin and total + n > chars:
            yield slice(begin, k)
            begin, total = k, 0
        total += n
    yield slice(begin, len(texts))


def token_ids(text: Column, path: str, batch_chars: int = 2_000_000) -> Column:
    """The ids of a text column as array<int>."""
    path = _shipped(path)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(path)
        for texts in batches:
            found: list[np.ndarray] = []
            for s in _slices(texts, batch_chars):
                found += bpe.encode_batch(texts.iloc[s].tolist())
            yield pd.Series(found, dtype=object)

    return F.pandas_udf(run, "array<int>")(text.cast("string"))


def encode(
    df: DataFrame,
    text: str = "text",
    out: str = "ids",
    tokenizer: str = "byte_bpe_50k",
    tokenizer_dir: str = TOKENIZER_DIR,
    batch_chars: int = 2_000_000,
) -> DataFrame:
    """df with the token ids of column ``text`` as array<int> in column ``out``.

    No special tokens are added and texts that look like them are plain text.
    Null, empty: an empty list, never null. Repeated rows: each row is kept.
    Very long texts: encoded whole; ``batch_chars`` only limits how many texts
    are merged together. Other columns are kept, unless named ``out``, which
    is replaced. An empty table gives an empty result. No shuffle takes place.
    """
    return df.withColumn(out, token_ids(F.col(f"`{text}`"), f"{tokenizer_dir}/{tokenizer}.json", batch_chars))


def token_counts(df: DataFrame, text: str = "text", out: str = "n_tokens", tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """df with the number of tokens of column ``text``, 0 for null and empty."""
    path = _shipped(f"{tokenizer_dir}/{tokenizer}.json")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(path)
        for texts in batches:
            found: list[int] = []
            for s in _slices(texts, 2_000_000):
                found += bpe.count_batch(texts.iloc[s].tolist())
            yield pd.Series(found, dtype="int32")

    return df.withColumn(out, F.pandas_udf(run, "int")(F.col(f"`{text}`").cast("string")))


def decode(df: DataFrame, ids: str = "ids", out: str = "bytes", tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """df with the bytes that column ``ids`` stands for in column ``out``; none for null and empty lists.

    Of ids from :func:`encode` these are the text's UTF-8 bytes.
    """
    path = _shipped(f"{tokenizer_dir}/{tokenizer}.json")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(path)
        for rows in batches:
            yield pd.Series([bpe.decode(r.tolist()) if r is not None else b"" for r in rows], dtype=object)

    return df.withColumn(out, F.pandas_udf(run, "binary")(F.col(f"`{ids}`")))

"""Text functions: NFC and nothing else, spans, content ids, keyed tokens."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Python's str.strip and str.split see it; the JVM's \s is ASCII.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"
#: Characters whose counts NFC may not change afterwards
#: (ta marbuta, alef maqsura, the hamza carriers and forms, vowel marks).
PROTECTED = ("ة", "ى", "أ", "إ", "آ", "ء", "ؤ", "ئ", "ً", "ٌ", "ٍ", "َ", "ُ", "ِ", "ّ", "ْ")


def strip(c: Column) -> Column:
    """Python's str.strip()."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def word_count(c: Column) -> Column:
    """len(str.split()): the number of words between Unicode blanks."""
    bare = strip(c)
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, f"{BLANK}+")))


def nfc(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with column in NFC as ``out``; nothing is folded or removed.

    Spark has no normaliser, so this is an Arrow UDF over the one scan of df;
    texts that are NFC already, as all of ASCII, are passed on as they are.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: t if t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t), na_action="ignore")

    return df.withColumn(out, F.pandas_udf(run, "string")(F.col(f"`{column}`")))


def protected_unchanged(before: Column, after: Column) -> Column:
    """Whether a step after NFC kept the count of every protected character."""
    count = lambda c, ch: F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))
    same = F.lit(True)
    for ch in PROTECTED:
        same = same & (count(before, ch) == count(after, ch))
    return same


def checksum(c: Column) -> Column:
    return F.sha2(c, 256)


def content_id(c: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of a text."""
    return F.substring(F.sha2(c, 256), 1, 16)


def spans(text: Column, tokens: Column) -> Column:
    """0-based half-open code point spans of tokens found in order.

    Each token is searched from the end of the one before; one that isn't
    there is placed at that point.
    """

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<char_start:int,char_end:int>>").alias("spans"))

    def merge(state: Column, token: Column) -> Column:
        place = F.position(token, text, state["at"] + 1)
        begin = F.when(place > 0, place - 1).otherwise(state["at"])
        end = begin + F.length(token)
        span = F.struct(begin.cast("int").alias("char_start"), end.cast("int").alias("char_end"))
        return F.struct(end.cast("int").alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    return F.aggregate(tokens, start, merge, lambda s: s["spans"])


def render(sentence: Column, start: Column, end: Column, left: str = "«", right: str = "»") -> Column:
    """The sentence with the cue's span between marks."""
    return F.concat(F.substring(sentence, F.lit(1), start), F.lit(left), F.substring(sentence, start + 1, end - start), F.lit(right), F.substring(sentence, end + 1, F.length(sentence)))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex from built-ins.

    The pads stand in the query plan, so use it only where plans aren't
    published; :func:`keyed_token` keeps the key in a closure.
    """
    import hashlib

    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    block = key.ljust(64, b"\0")
    inner = F.unhex(F.lit(bytes(b ^ 0x36 for b in block).hex()))
    outer = F.unhex(F.lit(bytes(b ^ 0x5C for b in block).hex()))
    first = F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(first)), 256)


def keyed_token(message: Column, key: bytes, length: int = 32) -> Column:
    """The first ``length`` hex digits of HMAC-SHA256, the key kept out of the plan."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import hashlib
        import hmac

        for s in batches:
            yield s.map(lambda t: hmac.new(key, t.encode(), hashlib.sha256).hexdigest()[:length], na_action="ignore")

    return F.pandas_udf(run, "string")(message)

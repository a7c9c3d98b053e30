"""Duplicates hidden by formatting: Merkle digests of normalised records.

A record's text is a tree. Running text is one leaf. A list of labelled
values is an unordered node of (label, value) children; values may be objects
(unordered again) or arrays (ordered) themselves. Leaves are normalised
(canonical decomposition, case folding; only letters, marks and digits stay),
digests go bottom-up, and an unordered node sorts its children's digests.
Records are grouped by root digest and confirmed by comparing the whole
normalised trees of each group.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.session import cut, join_split

#: Ids of one group that one task pairs with all of the group.
PAIR_BLOCK = 1_000

_DROP = regex.compile(r"[^\p{L}\p{M}\p{N}]+|\p{Default_Ignorable_Code_Point}+")
_BREAK = r"[\r\n\v\f\x85\u2028\u2029]+|[|;؛；•]"
_ITEMS = regex.compile(_BREAK)
_NESTED = regex.compile(rf"(?P<open>[{{\[])|(?P<close>[}}\]])|(?P<item>{_BREAK})")
_BULLET = regex.compile(r"[\s\p{Cf}]*(?:[-*–—•·▪‣◦+][\s\p{Cf}]*)?")
_NUMBER = regex.compile(r"[\s\p{Cf}]*(\p{Nd}+)[.)]\s+")
_COLON = regex.compile(r"[:=：]")
_GAP = regex.compile(r"[\s\p{Cf}]*")
_END = regex.compile(r"[\s\p{Cf}.!]*")
_Q = r"""[\p{Pi}\p{Pf}"'`„‟]+"""
_LABEL = regex.compile(rf"(?:{_Q}(.*?){_Q}|([^,،;；:=：{{}}\[\]\p{{Pi}}\p{{Pf}}\"'`]+?))[\s\p{{Cf}}]*[:=：][\s\p{{Cf}}]*", regex.S)
_VALUE = regex.compile(rf"(?:{_Q}(.*?){_Q}|([^,،;；{{}}\[\]\p{{Pi}}\p{{Pf}}\"'`]*))[\s\p{{Cf}}]*(?=[,،;；}}\]]|$)", regex.S)
_COMMA = regex.compile(r"[\s\p{Cf}]*[,،;；][\s\p{Cf}]*")


def normalise(text: str) -> str:
    """Letters, marks and digits, canonically decomposed and case-folded."""
    if text.isascii():
        return _DROP.sub("", text.lower())
    folded = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).casefold())
    return _DROP.sub("", folded)


class Digests:
    """Nodes as Merkle digests. A leaf stays a str until its parent is made."""

    def __init__(self, size: int = 16) -> None:
        self.size = size

    def _hash(self, kind: bytes, parts: list[bytes]) -> bytes:
        h = hashlib.blake2b(kind, digest_size=self.size)
        for p in parts:
            h.update(len(p).to_bytes(8, "big"))
            h.update(p)
        return h.digest()

    def root(self, node: str | tuple) -> bytes:
        return self._hash(b"leaf", [node.encode("utf-8", "surrogatepass")]) if isinstance(node, str) else node[0]

    def unordered(self, pairs: list[tuple[str, str | tuple]]) -> tuple:
        return (self._hash(b"set", sorted(self._hash(b"pair", [a.encode("utf-8", "surrogatepass"), self.root(b)]) for a, b in pairs)),)

    def ordered(self, nodes: list) -> tuple:
        return (self._hash(b"row", [self.root(n) for n in nodes]),)


class Trees(Digests):
    """Nodes as the trees themselves, written out; leaves hold none of the marks used."""

    def root(self, node: str | tuple) -> str:
        return node if isinstance(node, str) else node[0]

    def unordered(self, pairs: list[tuple[str, str | tuple]]) -> tuple:
        return ("{" + "\n".join(sorted(f"{a}\t{self.root(b)}" for a, b in pairs)) + "}",)

    def ordered(self, nodes: list) -> tuple:
        return ("[" + "\n".join(map(self.root, nodes)) + "]",)


def _nested(text: str, at: int, build: Digests) -> tuple[str | tuple, int, int] | None:
    """The object or array that begins at ``at``: its node, where it ends, how many pairs it has.

    Quotes of any kind, also none; no recursion, so any depth will do. An array
    of plain values is a leaf of all their letters, as punctuation counts nothing.
    """
    frames: list[tuple[str, list, str]] = []  # opening mark, children, the label in front of it
    pairs, label = 0, ""
    while True:
        at = _GAP.match(text, at).end()
        mark = text[at : at + 1]
        value: str | tuple | None = None
        if frames and frames[-1][0] == "{" and mark not in "}," and not label:
            m = _LABEL.match(text, at)
            if not m or not (label := normalise(m[1] or m[2] or "")):
                return None
            at = m.end()
            mark = text[at : at + 1]
        if mark and mark in "{[":
            frames.append((mark, [], label))
            label = ""
            at += 1
            continue
        if mark and mark in "}]":
            if not frames or (frames[-1][0] == "{") != (mark == "}") or label:
                return None
            opened, children, label = frames.pop()
            at += 1
            if opened == "{":
                value = build.unordered(children)
            elif any(isinstance(c, tuple) for c in children):
                value = build.ordered(children)
            else:
                value = "".join(children)
        else:
            m = _VALUE.match(text, at)
            if not m or not frames:
                return None
            value, at = normalise(m[1] or m[2] or ""), m.end()
        if not frames:
            return value, at, pairs
        opened, children, _ = frames[-1]
        if opened == "{":
            if label:
                children.append((label, value))
                pairs += 1
            label = ""
        elif value != "":
            children.append(value)
        if m := _COMMA.match(text, at):
            at = m.end()
        elif text[_GAP.match(text, at).end() :][:1] not in ("}", "]"):
            return None


def _split_items(text: str) -> list[str]:
    """The pieces between line ends, bars and semicolons outside of brackets."""
    if "{" not in text and "[" not in text:
        return _ITEMS.split(text)
    found, depth, begin = [], 0, 0
    for m in _NESTED.finditer(text):
        if m["open"]:
            depth += 1
        elif m["close"]:
            depth -= 1
        elif depth == 0:
            found.append(text[begin : m.start()])
            begin = m.end()
        if depth < 0:
            break
    return [*found, text[begin:]] if depth == 0 else _ITEMS.split(text)


def labelled(text: str, build: Digests) -> str | tuple | None:
    """The root of the tree if the text is just a list of labelled values, else None.

    Items stand on lines of their own, between bars or semicolons, or as an
    object's members; bullets and consecutive numbers before all are layout.
    Labels are whatever stands before the first colon or equals sign, however
    long; a list has at least two.
    """
    begin = _GAP.match(text).end()
    if text[begin : begin + 1] == "{" and (found := _nested(text, begin, build)) and _END.match(text, found[1]).end() == len(text):
        return found[0] if found[2] > 1 else None
    items = [i for i in _split_items(text) if i and not i.isspace()]
    if len(items) < 2:
        return None
    numbers = [_NUMBER.match(i) for i in items]
    if all(numbers) and all(int(b[1]) - int(a[1]) == 1 for a, b in zip(numbers, numbers[1:])):
        items = [i[m.end() :] for i, m in zip(items, numbers)]
    pairs = []
    for item in items:
        colon = _COLON.search(item, at := _BULLET.match(item).end())
        if not colon:
            if _DROP.sub("", item):
                return None
            continue
        label = normalise(item[at : colon.start()])
        if not label or label.isdecimal():
            return None
        value = item[colon.end() :]
        at = _GAP.match(value).end()
        inner = _nested(value, at, build) if value[at : at + 1] in ("{", "[") else None
        if inner and _END.match(value, inner[1]).end() == len(value):
            pairs.append((label, inner[0]))
        else:
            pairs.append((label, normalise(value)))
    return build.unordered(pairs) if len(pairs) > 1 else None


def tree(text: str | None, build: Digests) -> tuple:
    """(plain, list): the text as one leaf; as a list of labelled values, if it is one.

    A text without any letter, mark or digit has no content to compare and
    gets neither, like null.
    """
    if not text or not (plain := normalise(text)):
        return None, None
    as_list = labelled(text, build)
    return build.root(plain), None if as_list is None else build.root(as_list)


def _per_text(build: Digests, kind: str, column: str) -> Column:
    """plain and list of each text, as struct<plain, list>."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([tree(t, build) for t in texts], columns=["plain", "list"], dtype=object)

    return F.pandas_udf(run, f"struct<plain: {kind}, list: {kind}>")(column)


def _both(df: DataFrame, *columns: str) -> DataFrame:
    """One row per kind of root: columns, kind and the root of that kind, nulls left out."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("root")) for k, c in (("text", "plain"), ("list", "list"))]))
    return df.select(*columns, each.alias("g")).select(*columns, "g.kind", "g.root").where("root IS NOT NULL")


def digests(df: DataFrame, key: str = "doc_id", text: str = "text_raw", size: int = 16) -> DataFrame:
    """One row per id and roots: id, plain, list, n_rows (deliveries); kept by a checkpoint.

    Only digests and ids are shuffled, and counts are combined before the
    shuffle, so a root shared by a third of all rows is no hot key.
    """
    rows = df.select(F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{text}`").alias("t")).where("id IS NOT NULL")
    rows = rows.select("id", _per_text(Digests(size), "binary", "t").alias("r"))
    return cut(rows.groupBy("id", "r.plain", "r.list").agg(F.count("*").alias("n_rows")))


def verified(df: DataFrame, key: str = "doc_id", text: str = "text_raw", size: int = 16) -> DataFrame:
    """:func:`digests` after a comparison in full: equal roots have equal trees.

    Of every root with several ids the smallest and the largest written-out
    tree are compared, which takes the whole trees of all members but combines
    them before the shuffle, however many share a root. Texts of other ids
    aren't shuffled: candidates are found by id, spread over tasks if one id
    has very many rows. Where trees differ, a digest of 256 bits of the tree is
    appended to the root, so that members are told apart.
    """
    ids = digests(df, key, text, size)
    several = _both(ids, "id").groupBy("kind", "root").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("kind", "root")
    members = cut(join_split(_both(ids, "id"), several, ["kind", "root"], F.col("id"), "left_semi").select("id").distinct())
    texts = df.select(F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{text}`").alias("t")).where("id IS NOT NULL")
    texts = join_split(texts, members, ["id"], F.monotonically_increasing_id(), "left_semi")
    both = texts.select("id", _per_text(Digests(size), "binary", "t").alias("r"), _per_text(Trees(), "string", "t").alias("s"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"r.{c}").alias("root"), F.col(f"s.{c}").alias("tree")) for k, c in (("text", "plain"), ("list", "list"))]))
    trees = both.select("id", each.alias("g")).select("id", "g.*").where("root IS NOT NULL")
    mixed = cut(trees.groupBy("kind", "root").agg(F.min("tree").alias("low"), F.max("tree").alias("high")).where("low < high").select("kind", "root"))
    if mixed.isEmpty():
        return ids
    apart = join_split(trees, mixed, ["kind", "root"], F.col("id"), "left_semi").select("id", "kind", "root", F.unhex(F.sha2("tree", 256)).alias("more")).distinct()
    apart = cut(apart.groupBy("id", "kind", "root").agg(F.min("more").alias("more")))
    for kind, column in (("text", "plain"), ("list", "list")):
        own = apart.where(F.col("kind") == kind).select("id", F.col("root").alias(column), "more")
        ids = ids.join(own, ["id", column], "left").withColumn(column, F.when(F.col("more").isNull(), F.col(column)).otherwise(F.concat(column, "more"))).drop("more")
    return cut(ids.select("id", "plain", "list", "n_rows"))


def pairs(df: DataFrame, key: str = "doc_id", text: str = "text_raw", kinds: tuple[str, ...] = ("text", "list"), block: int = PAIR_BLOCK, size: int = 16) -> DataFrame:
    """All pairs of different ids that agree as running text or as lists, smaller id first.

    The number of pairs is that of the definition; a group of n ids is paired
    by n / ``block`` tasks, each of which has the group and a block of it. For
    one row per id see :func:`classes`.

    Null ids and texts, and texts without letters, marks and digits, are in no
    pair. Repeated rows count once; an id with several texts is paired by each
    of them. Texts are read whole, whatever their length. Other columns are
    ignored. An empty table gives an empty result.
    """
    rows = _both(verified(df, key, text, size), "id").where(F.col("kind").isin(*kinds)).distinct()
    sizes = rows.groupBy("kind", "root").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    members = join_split(rows, sizes, ["kind", "root"], F.col("id"))
    a = members.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("kind", "root", "block", F.col("id").alias(f"{key}_a"))
    b = members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select("kind", "root", "block", F.col("id").alias(f"{key}_b"))
    return a.join(b, ["kind", "root", "block"]).where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b").distinct()


def classes(df: DataFrame, key: str = "doc_id", text: str = "text_raw", size: int = 16) -> DataFrame:
    """One row per id and class: id, root, n_rows (deliveries), first_id (the class's smallest id).

    Classes are compared in full, as pairs are. As running texts and lists may
    chain, a text whose list layout can't be told joins the class of the list
    that has its letters in the same order. A null text or one without letters,
    marks and digits is a class of its own (root null). Null ids are ignored.
    An empty table gives an empty result.
    """
    ids = verified(df, key, text, size)
    by_plain = ids.where("plain IS NOT NULL").groupBy("plain").agg(F.min("list").alias("any_list")).where("any_list IS NOT NULL")
    ids = join_split(ids, by_plain, ["plain"], F.col("id"), "left").select("id", "n_rows", F.coalesce("list", "any_list", "plain").alias("root"))
    firsts = ids.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("first_id"))
    out = join_split(ids.where("root IS NOT NULL"), firsts, ["root"], F.col("id")).select("id", "root", "n_rows", "first_id")
    return out.unionByName(ids.where("root IS NULL").withColumn("first_id", F.col("id")))


def collapsed(df: DataFrame, key: str = "doc_id", text: str = "text_raw", size: int = 16) -> DataFrame:
    """One row per record: record_id (its first id), n_copies (ids), n_rows.

    Nulls, ties and repeated rows as in :func:`classes`.
    """
    c = classes(df, key, text, size)
    c = c.groupBy(F.col("first_id").alias("record_id"), "id").agg(F.sum("n_rows").alias("n_rows"))
    return c.groupBy("record_id").agg(F.count("*").alias("n_copies"), F.sum("n_rows").alias("n_rows"))

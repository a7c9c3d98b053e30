"""Record invariants as violations, not as dropped rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Closed vocabularies. PENDING is what classify gives tier C before its target is resolved.
VOCABULARIES = {
    "doc_type": ("ad", "cv"),
    "country": ("EG", "JO", "SA", "AE"),
    "seniority": ("entry", "mid", "senior", "unspecified"),
    "gen": ("m", "f"),
    "tier": ("A", "B", "C"),
    "referent": ("applicant", "non_applicant", "ABSTAIN", "PENDING"),
    "abstain_reason": ("AB1", "AB2", "AB3", "AB4", "AB5", "AB6"),
}


def _rules(df: DataFrame, vocabularies: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    rules = {f"{c} is unknown": F.col(c).isNotNull() & ~F.col(c).isin(*v) for c, v in vocabularies.items() if c in df.columns}
    if {"referent", "abstain_reason"} <= set(df.columns):
        rules["ABSTAIN without reason or reason without ABSTAIN"] = (F.coalesce("referent", F.lit("")) == "ABSTAIN") != F.col("abstain_reason").isNotNull()
    if {"tier", "head_token"} <= set(df.columns):
        rules["head token outside tier C"] = F.col("head_token").isNotNull() & (F.coalesce("tier", F.lit("")) != "C")
    if {"char_start", "char_end"} <= set(df.columns):
        rules["empty or negative span"] = (F.col("char_start") < 0) | (F.col("char_end") <= F.col("char_start"))
    return rules


def violations(df: DataFrame, key: str, vocabularies: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(key, rule) of every broken invariant of the columns that are there."""
    rules = _rules(df, VOCABULARIES if vocabularies is None else vocabularies)
    each = [F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]
    if not each:
        return df.select(key, F.lit("").alias("rule")).limit(0)
    return df.select(key, F.explode(F.array_compact(F.array(*each))).alias("rule"))


def assert_valid(df: DataFrame, key: str, vocabularies: dict[str, tuple[str, ...]] | None = None) -> None:
    bad = violations(df, key, vocabularies).limit(5).collect()
    if bad:
        raise ValueError(f"invalid rows: {bad}")

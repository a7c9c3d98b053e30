"""The job-ad corpus: a CSV scan into document records."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.functions.text import checksum, content_id, nfc, strip, word_count

#: The corpus's country names and their codes.
COUNTRIES = {"Egypt": "EG", "Jordan": "JO", "Saudi Arabia": "SA", "UAE": "AE"}


class EmptyCorpus(ValueError):
    """No document with text."""


def _local(path: str) -> str | None:
    if path.startswith("file://"):
        return path[7:]
    return None if "://" in path else path


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The CSV's rows as strings: UTF-8 with or without BOM, quoted line breaks.

    A line break may stand inside quotes, so a file is one split; many files
    are read in parallel.
    """
    local = _local(path)
    if local and "*" not in local and not os.path.exists(local):
        raise FileNotFoundError(f"{path}: no such corpus; give the path of the job-ad CSV")
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")


def country_code(name: Column) -> Column:
    """The country's code; an unknown name raises when it is read."""
    known = F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv])
    bad = F.concat(F.lit("unmapped country: "), F.coalesce(name, F.lit("null")))
    return F.coalesce(known[name], F.raise_error(bad).cast("string"))


def records(rows: DataFrame, text: str = "description") -> DataFrame:
    """Document records of the rows that have text, in NFC.

    Texts are stripped; doc_id is a hash of the content, so equal texts share
    it. The corpus has no seniority: all records are unspecified.
    """
    raw = rows.withColumn("text_raw", strip(F.col(text))).where("text_raw <> ''")
    out = raw.select(
        content_id(F.col("text_raw")).alias("doc_id"),
        F.lit("ad").alias("doc_type"),
        "text_raw",
        country_code(strip(F.col("country"))).alias("country"),
        strip(F.coalesce("profession", F.lit(""))).alias("occupation"),
        F.lit("unspecified").alias("seniority"),
        checksum(F.col("text_raw")).alias("source_checksum"),
    )
    return nfc(out, "text_raw", "text_norm")


def load(spark: SparkSession, path: str) -> DataFrame:
    return records(scan(spark, path))


def file_checksum(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes (below 2 GB) as the executors read them."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def label_counts(rows: DataFrame, label: str = "gender", text: str = "description") -> DataFrame:
    """(label, n) of the rows with text, trimmed; unknown where there is none."""
    name = strip(F.coalesce(F.col(label), F.lit("")))
    kept = rows.where(strip(F.col(text)) != "")
    return kept.groupBy(F.when(name == "", "unknown").otherwise(name).alias("label")).agg(F.count("*").alias("n"))


def describe(docs: DataFrame) -> DataFrame:
    """(dimension, value, n, mean_chars, mean_tokens): all, by country, by occupation.

    An empty or null occupation is (unspecified). One scan and one shuffle by
    grouping sets.
    """
    named = F.when(F.coalesce("occupation", F.lit("")) == "", "(unspecified)").otherwise(F.col("occupation")).alias("occupation")
    rows = docs.select("country", named, F.length("text_norm").alias("chars"), word_count(F.col("text_norm")).alias("tokens"))
    sets = rows.groupingSets([[], ["country"], ["occupation"]], "country", "occupation").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.avg("chars").alias("mean_chars"), F.avg("tokens").alias("mean_tokens")
    )
    names = {3: ("all", F.lit("all")), 1: ("country", F.col("country")), 2: ("occupation", F.col("occupation"))}
    dimension, value = F.lit(None), F.lit(None)
    for g, (name, column) in names.items():
        dimension = F.when(F.col("g") == g, name).otherwise(dimension)
        value = F.when(F.col("g") == g, column).otherwise(value)
    return sets.select(dimension.alias("dimension"), value.alias("value"), "n", "mean_chars", "mean_tokens")


def summary(spark: SparkSession, path: str) -> DataFrame:
    """:func:`describe` of a corpus file, with the source's own labels and the file's checksum.

    Rows of dimension source_label count rows with text by label; the row of
    dimension checksum has it as value. A corpus without text raises.
    """
    rows = scan(spark, path)
    docs = records(rows)
    assert_not_empty(docs)
    none = F.lit(None).cast("double")
    labels = label_counts(rows).select(F.lit("source_label").alias("dimension"), F.col("label").alias("value"), "n", none.alias("mean_chars"), none.alias("mean_tokens"))
    digest = spark.range(1).select(F.lit("checksum").alias("dimension"), F.lit(file_checksum(spark, path)).alias("value"), F.lit(None).cast("bigint").alias("n"), none.alias("mean_chars"), none.alias("mean_tokens"))
    return describe(docs).unionByName(labels).unionByName(digest)


def assert_not_empty(docs: DataFrame) -> None:
    if docs.isEmpty():
        raise EmptyCorpus("the corpus has no document with text")


def top_categories(docs: DataFrame, column: str = "occupation", k: int = 10) -> DataFrame:
    """The k most frequent values, ties by name."""
    return docs.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(k)

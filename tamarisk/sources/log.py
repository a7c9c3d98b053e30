"""The append-only annotation log and item files, as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators.annotation import LABELS, assert_item_schema

RESPONSE = "seq bigint, item_id string, annotator_id string, answer string, timestamp string, comment string"
ITEM = "item_id string, sentence string, cue_start int, cue_end int, doc_type string"
DOC_TYPES = ("ad", "cv")


class AnnotationLog:
    """A folder of JSON lines. There is no way to change or remove a row."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, responses: DataFrame) -> None:
        """Add responses; an answer outside the labels or an empty annotator raises first."""
        bad = responses.where(~F.coalesce(F.col("answer").isin(*LABELS), F.lit(False)) | (F.coalesce("annotator_id", F.lit("")) == ""))
        if not bad.isEmpty():
            raise ValueError(f"invalid responses: {bad.limit(3).collect()}")
        fields = [f for f in RESPONSE.replace(" bigint", "").replace(" string", "").split(", ") if f in responses.columns]
        responses.select(*sorted(fields)).write.mode("append").json(self.path)

    def responses(self, check: bool = True) -> DataFrame:
        """All rows; a malformed line raises. Order is that of seq, and blank lines count nothing.

        ``check`` reads the log once beforehand, so that the error names file
        and line; without it the error comes when the rows are read.
        """
        if check:
            bad = self.bad_lines().limit(3).collect()
            if bad:
                raise ValueError("not valid JSON: " + "; ".join(f"{file}:{line}: {text}" for file, line, text in bad))
        return self.spark.read.schema(RESPONSE).option("mode", "FAILFAST").json(self.path)

    def bad_lines(self) -> DataFrame:
        """(file, line, text) of lines that aren't JSON objects, counted from 1.

        Only files that have such lines are read again, one after another, to
        count the lines before them.
        """
        broken = lambda rows: rows.where((F.trim("value") != "") & F.coalesce(F.try_parse_json("value").isNull() | ~F.trim("value").startswith("{"), F.lit(True)))
        files = broken(self.spark.read.text(self.path).select("value", "_metadata.file_path")).select("file_path").distinct()
        found = []
        for r in files.toLocalIterator():
            lines = self.spark.read.text(r.file_path).rdd.map(lambda x: x.value).zipWithIndex()
            rows = lines.map(lambda x: (x[1] + 1, x[0])).toDF("line bigint, value string")
            found.append(broken(rows).select(F.lit(r.file_path).alias("file"), "line", F.col("value").alias("text")))
        out = self.spark.createDataFrame([], "file string, line bigint, text string")
        for f in found:
            out = out.unionByName(f)
        return out.orderBy("file", "line")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON lines with exactly their five fields; an unknown doc_type raises."""
    items = spark.read.schema(ITEM).option("mode", "FAILFAST").json(path)
    assert_item_schema(items)
    known = F.col("doc_type").isin(*DOC_TYPES)
    bad = F.raise_error(F.concat(F.lit("unknown doc_type: "), F.coalesce("doc_type", F.lit("null")))).cast("string")
    return items.withColumn("doc_type", F.when(known, F.col("doc_type")).otherwise(bad))


UNBLINDING = "blind_token string, who string, reason string, at string"


class UnblindingLog:
    """An append-only record of which tokens were unblinded, by whom and why.

    A token can be unblinded once; there is no way back.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def entries(self) -> DataFrame:
        from pyspark.sql.utils import AnalysisException

        try:
            return self.spark.read.schema(UNBLINDING).option("mode", "FAILFAST").json(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], UNBLINDING)

    def append(self, entries: DataFrame) -> None:
        """Record unblindings; a repeated token or a blank who or reason raises first."""
        blank = (F.trim(F.coalesce("who", F.lit(""))) == "") | (F.trim(F.coalesce("reason", F.lit(""))) == "")
        if not entries.where(blank | F.col("blind_token").isNull()).isEmpty():
            raise ValueError("an unblinding needs a token, a name and a reason")
        again = entries.groupBy("blind_token").count().where("count > 1").select("blind_token")
        again = again.unionByName(entries.join(self.entries().select("blind_token"), "blind_token", "left_semi").select("blind_token"))
        if not again.isEmpty():
            raise ValueError(f"already unblinded: {again.limit(3).collect()}")
        entries.select("blind_token", "who", "reason", "at").write.mode("append").json(self.path)

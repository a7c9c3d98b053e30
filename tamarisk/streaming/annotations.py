"""The annotation log as a stream: latest answers, running rates and kappa."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators import annotation
from tamarisk.sources.log import RESPONSE


def read(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """The log's JSON lines as they arrive."""
    return spark.readStream.schema(RESPONSE).option("maxFilesPerTrigger", max_files).json(path)


def latest(stream: DataFrame) -> DataFrame:
    """The last answer of each (annotator, item) so far, for update or complete mode.

    State is one row for each (annotator, item), which is what there is to
    annotate; it has no watermark, as an answer may be revised at any time.
    Answers outside the labels are left out, as a stream has no one to raise to.
    """
    return annotation.last_answers(annotation.answers(stream, strict=False))


def rates(stream: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Answers and unclear rate by event-time window; later rows than ``late`` are left out of closed windows."""
    timed = stream.withColumn("at", F.try_to_timestamp("timestamp")).where("at IS NOT NULL").withWatermark("at", late)
    label = annotation.canonical_answer(F.col("answer"))
    rows = timed.withColumn("label", label).where("label IS NOT NULL")
    out = rows.groupBy(F.window("at", window).alias("w")).agg(F.count("*").alias("n_answers"), F.avg((F.col("label") == "unclear").cast("double")).alias("unclear_rate"))
    return out.select(F.col("w.start").alias("window_start"), "n_answers", "unclear_rate")


def _files(spark: SparkSession, path: str):
    """The Hadoop file system and path object of a path, as the driver sees them."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _versions(spark: SparkSession, target: str) -> list[int]:
    """The numbers of the versions that were written to the end."""
    fs, where = _files(spark, target)
    if not fs.exists(where):
        return []
    jvm = spark.sparkContext._jvm
    found = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("version=")]
    return sorted(int(p.getName()[8:]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _files(spark, path)
    fs.delete(where, True)


def kappas(spark: SparkSession, target: str) -> DataFrame:
    """The newest version that :func:`start_kappa` wrote."""
    found = _versions(spark, target)
    if not found:
        raise FileNotFoundError(f"{target}: no kappas yet")
    return spark.read.parquet(f"{target}/version={found[-1]}")


def start_kappa(stream: DataFrame, target: str, checkpoint: str, once: bool = True):
    """Keep kappas of all pairs of annotators up to date in the folder ``target``; :func:`kappas` reads them.

    Each batch writes a version of its own under its number, so a repeated
    batch changes nothing and readers always find a whole table; of older
    versions the last one is kept, for readers that are still at it.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.coalesce("seq", F.lit(0)).alias("seq"), "item_id", "annotator_id", "answer")
        annotation.gate_status(annotation.kappa_pairs(rows)).write.mode("overwrite").parquet(f"{target}/version={number}")
        for old in _versions(batch.sparkSession, target):
            if old < number - 1:
                _delete(batch.sparkSession, f"{target}/version={old}")

    query = latest(stream).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()

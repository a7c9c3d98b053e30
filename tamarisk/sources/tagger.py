"""The seam for a disambiguator: texts in, analysed tokens out.

No model is shipped. A factory is called once per worker; it gives a function
from text to (tokens, candidates per token). Without one, the engine reads a
table of candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.functions.cues import TOP_N
from tamarisk.functions.text import spans

CANDIDATE = "struct<score: double, pos: string, rat: string, gen: string, form_gen: string, stemcat: string>"


def analyse(docs: DataFrame, factory: Callable[[], Callable], key: str = "doc_id", text: str = "text_norm", toolkit_version: str = "", db_version: str = "", top: int = TOP_N) -> DataFrame:
    """One row per token: key, index, token, char_start, char_end, candidates, versions."""
    if top != TOP_N:
        raise ValueError(f"retention must be {TOP_N}, got {top}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            rows = [(k, t, *model(t)) for k, t in zip(batch[key], batch[text]) if t]
            yield pd.DataFrame(rows, columns=[key, text, "tokens", "candidates"])

    kind = dict(docs.dtypes)[key]
    rows = docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, `{text}` string, tokens array<string>, candidates array<array<{CANDIDATE}>>")
    rows = rows.withColumn("spans", spans(F.col(text), F.col("tokens")))
    each = rows.select(key, F.posexplode(F.arrays_zip("tokens", "spans", "candidates")).alias("index", "t"))
    return each.select(
        key, "index", F.col("t.tokens").alias("token"), F.col("t.spans.char_start").alias("char_start"), F.col("t.spans.char_end").alias("char_end"),
        F.slice("t.candidates", 1, TOP_N).alias("candidates"), F.lit(toolkit_version).alias("toolkit_version"), F.lit(db_version).alias("db_version"),
    )

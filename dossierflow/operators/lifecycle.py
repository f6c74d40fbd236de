"""Work that is taken up again: windows, pages and files with a state that survives a lost job.

A marker is a column of the same write as the result it marks, so there is no moment at which one
is there without the other; running again does what is left and adds nothing twice.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import upkeep


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def classify_pending(spark: SparkSession, windows: DataFrame, path: str, classify: Callable[[DataFrame], DataFrame], key: str = "key") -> int:
    """Classifies the windows that the table at path does not name, and appends their items; returns how many windows were done.

    classify gives rows with column key; a window without items gets one row of nulls, which marks it as done.
    """
    done = _table(spark, path)
    pending = windows if done is None else windows.join(done.select(key).distinct(), key, "left_anti")
    pending = pending.persist()
    n = pending.count()
    if n:
        items = classify(pending)
        empty = pending.select(key).join(items.select(key).distinct(), key, "left_anti")
        items.unionByName(empty, allowMissingColumns=True).write.mode("append").parquet(path)
    pending.unpersist()
    return n


def apply_pending(tables: dict[str, DataFrame], found: DataFrame, key: dict[str, list[str]]) -> dict[str, DataFrame]:
    """tables without the rows of changed files. found: relative_path, status. New files have no rows yet; removals are never applied by themselves."""
    stale = found.filter("status = 'changed'")
    return {name: upkeep.without(frame, stale, key[name]) if name in key else frame for name, frame in tables.items()}


def discard_file(tables: dict[str, DataFrame], path: str, key: dict[str, str]) -> dict[str, DataFrame]:
    """tables without the rows of one file; key: the column that names a file in each table."""
    return {name: frame.filter(~F.col(key[name]).eqNullSafe(F.lit(path))) if name in key else frame for name, frame in tables.items()}


def resume_point(progress: DataFrame, listing: DataFrame) -> DataFrame:
    """relative_path, pages: how many pages of each listed file are there already; progress that was made on another size or time counts nothing.

    progress: relative_path, size, mtime, number (a row for each page). Pages count up to the first gap.
    """
    bound = listing.join(progress.withColumnsRenamed({"size": "__s", "mtime": "__m"}), "relative_path", "left")
    mine = F.when((F.col("size") == F.col("__s")) & (F.col("mtime") == F.col("__m")), F.col("number"))
    numbers = bound.select("relative_path", mine.alias("n")).distinct()
    # numbers 1..k are whole exactly where the kth in order is k: counted without a sort of a file's pages
    sums = numbers.groupBy("relative_path").agg(F.sort_array(F.collect_list("n")).alias("all"))
    gap = F.array_position(F.zip_with("all", F.sequence(F.lit(1), F.greatest(F.size("all"), F.lit(1))), lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    return sums.select("relative_path", F.when(F.size("all") == 0, 0).when(gap == 0, F.size("all")).otherwise(gap - 1).cast("long").alias("pages"))


def retry_of(files: DataFrame, windows: DataFrame, finished: list[str]) -> DataFrame:
    """file_id, retry: what becomes of files whose OCR failed (file_id, status, ocr_failed).

    requeue: its conversion has ended; held_back: it is extracted and windows exist, so that a new
    reading would move positions. Other files have no row.
    """
    rows = files.filter(F.col("ocr_failed") & F.col("status").isin(*finished))
    held = F.lit(not windows.isEmpty()) & (F.col("status") == "extracted")
    return rows.select("file_id", F.when(held, "held_back").otherwise("requeue").alias("retry"))


def event(step: str, level: str, key: str, params: Column, template: str) -> list[Column]:
    """Columns of an event: step, level, message_key, message_params (JSON) and the template with {name} filled in.

    params: a map of texts.
    """
    entries = F.map_entries(params)
    message = F.aggregate(entries, F.lit(template), lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    return [F.lit(step).alias("step"), F.lit(level).alias("level"), F.lit(key).alias("message_key"), F.to_json(params).alias("message_params"), message.alias("message")]


def chunks(text: str | None, least: int = 400) -> list[str]:
    """text in pieces of whole lines; a piece closes with the line that brings it to `least` characters, line ends counted."""
    if not text:
        return []
    out, start = [], 0
    for end in [m.end() for m in re.finditer("\n", text)] + [len(text) + 1] * (not text.endswith("\n")):
        if end - start >= least:
            out.append(text[start : end - 1])
            start = end
    return out + [text[start:].removesuffix("\n")] * (start < len(text))


def language_chunks(docs: DataFrame, id_col: str = "doc_id", least: int = 400) -> DataFrame:
    """id, seq, text: the chunks of each text, in Arrow batches; each text is cut in one pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i + 1, c) for k, text in zip(batch[id_col], batch["text"], strict=True) for i, c in enumerate(chunks(text, least))]
            yield pd.DataFrame(rows, columns=[id_col, "seq", "text"])

    return docs.select(id_col, "text").mapInPandas(run, T.StructType([docs.schema[id_col], T.StructField("seq", T.LongType()), T.StructField("text", T.StringType())]))

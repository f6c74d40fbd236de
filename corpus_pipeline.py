"""The corpus pipeline: quality rules, line dedup, near-dedup, personal data, packing.

Each stage takes the rows that its predecessor kept, with the columns of documents, and all but
the last return those columns; other columns of the input are left behind. Rows with a null
doc_id stay as long as their text does; repeated rows share their verdicts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.llm import common, lines, near, packing, pii, repetition

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL can express neither suffix arrays nor fingerprints nor the trained tagger.
ORACLE_SQL: str | None = None


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return repetition.keep(docs.select(COLUMNS))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier in the collection; those with no line left go."""
    return _counted(lines.line_dedup(docs.select(COLUMNS)).filter(~F.col("emptied")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    groups = near.near_duplicates(docs)
    stay = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept")).distinct()
    return docs.select(COLUMNS).join(stay, F.col("doc_id").eqNullSafe(F.col("kept")), "left_semi")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return _counted(pii.mask(docs.select(COLUMNS)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in the packed sequences."""
    return packing.best_fit(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage), ("lines", line_stage), ("near_duplicates", near_stage), ("pii", pii_stage), ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage keeps is written to the shared folder for the next."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.cut(docs)
    return docs

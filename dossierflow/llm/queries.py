"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, licences, lines, packing, pii, quality, repetition, simhash, topk
from .common import fold, table


def _with_fold(df: DataFrame) -> DataFrame:
    """held_out after doc_id: whether the row is kept from learning."""
    return df.select("doc_id", F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"), *df.columns[1:])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates are the clusters: texts of one group never share a bin."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0))
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"), extra={"source": F.col("source"), "size": size, "th": F.xxhash64("text").cast("string")})
    # the hash of a text stands for it: only ties in length need it
    return packing.best_fit(groups, text_col="th", cluster_col="component_id", size_col="size")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_fold(quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "emptied", F.sha2("text", 256).alias("text_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_fold(langid.language_id(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_pii, op2_packing, op3_simhash, op4_quality, op5_lines, op6_quality_rules, op7_bpe, op8_topk, op9_licences, op10_language)}

#: Line dedup by comparing every pair of lines of similar length; top-k by scoring every pair.
ORACLE = {
    "op5_lines": """
        WITH parts AS (
            SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
        ), solid AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '' AS is_solid FROM parts
        ), firsts AS (SELECT line, min((doc_id, pos)) AS first FROM solid WHERE is_solid GROUP BY line
        ), near AS (
            SELECT DISTINCT y.line FROM firsts x JOIN firsts y
            ON length(y.line) BETWEEN length(x.line) - 1 AND length(x.line) + 1 AND x.first < y.first AND length(x.line) >= 20 AND length(y.line) >= 20
            WHERE levenshtein(x.line, y.line) = 1
        ), judged AS (
            SELECT s.*, s.is_solid AND (near.line IS NOT NULL OR (s.doc_id, s.pos) <> f.first) AS gone
            FROM solid s LEFT JOIN firsts f ON s.is_solid AND s.line = f.line LEFT JOIN near ON s.line = near.line
        ), cleaned AS (
            SELECT doc_id, count(*) FILTER (is_solid) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT coalesce(gone, false)) AS t
            FROM judged GROUP BY doc_id
        )
        SELECT doc_id, n_lines, n_removed, n_removed > 0 AND n_removed = n_lines AS emptied, sha256(coalesce(t, '')) AS text_sha256 FROM cleaned
    """,
    "op8_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pairs AS (
            SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r
        )
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM pairs
        WINDOW w AS (PARTITION BY r ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
    """,
}

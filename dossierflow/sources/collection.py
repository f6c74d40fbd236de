"""The collection's frames: files, pages and pieces, each from the table that plays its part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions dealt to the files in turn.
EXTENSIONS = ["pdf", "docx", "txt", "md", "html", "zip", "mp3", "pem", "gdoc", "exe", "xyz", "eml"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: path, name, extension, size, content hash, group, language, text."""
    docs = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    name = F.concat(F.lit("doc"), F.col("doc_id"), F.lit("."), ext)
    return docs.select(
        F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", "lang", name).alias("relative_path"), name.alias("name"), ext.alias("extension"),
        F.col("n_chars").alias("size"), F.sha2("text", 256).alias("sha256"), F.col("source").alias("group_key"), F.col("lang").alias("language"), "text",
    )


FILES_SQL = f"""files AS (
    SELECT doc_id AS file_id, {EXTENSIONS}[doc_id % {len(EXTENSIONS)} + 1] AS extension, 'doc' || doc_id || '.' || {EXTENSIONS}[doc_id % {len(EXTENSIONS)} + 1] AS name,
        source || '/' || lang || '/doc' || doc_id || '.' || {EXTENSIONS}[doc_id % {len(EXTENSIONS)} + 1] AS relative_path, n_chars AS size, sha256(text) AS sha256,
        source AS group_key, lang AS language, text FROM documents)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each message of a mailbox: its page."""
    talks = table(spark, sf_dir, "conversations")
    return talks.select(
        F.col("conv_id").alias("file_id"), F.concat(F.lit("box"), F.col("conv_id"), F.lit(".mbox")).alias("path"), (F.col("turn") + 1).alias("number"),
        F.concat(F.lit("g"), F.col("conv_id") % 7).alias("group_key"), "role", "text",
    )


PAGES_SQL = """pages_ AS (
    SELECT conv_id AS file_id, 'box' || conv_id || '.mbox' AS path, turn + 1 AS number, 'g' || (conv_id % 7) AS group_key, role, text FROM conversations)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each piece of an index: an interval of positions of its group."""
    li = table(spark, sf_dir, "lineitem")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    third = F.col("l_linenumber") % 3
    start = F.col("l_partkey") * 7 % 400 + 1
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("group_key"), start.alias("start_order"),
        (start + F.col("l_linenumber") % 4).alias("end_order"), F.when(F.col("l_returnflag") == "A", "REPORT").when(F.col("l_returnflag") == "R", "LETTER").alias("type"),
        F.when(third == 0, day).when(third == 1, F.substring(day, 1, 7)).alias("date"), F.when(F.col("l_linestatus") == "O", F.concat(F.lit("M. Souza"), F.col("l_partkey") % 5)).alias("author"),
        F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (third + 1).cast("int")).alias("confidence"),
        F.when(F.col("l_linenumber") % 2 == 0, "rules").otherwise("local").alias("engine"),
    )


ITEMS_SQL = """items AS (
    SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS line, 's' || l_suppkey AS group_key, l_partkey * 7 % 400 + 1 AS start_order,
        l_partkey * 7 % 400 + 1 + l_linenumber % 4 AS end_order, CASE l_returnflag WHEN 'A' THEN 'REPORT' WHEN 'R' THEN 'LETTER' END AS type,
        CASE l_linenumber % 3 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 1 THEN strftime(l_shipdate, '%Y-%m') END AS date,
        CASE WHEN l_linestatus = 'O' THEN 'M. Souza' || (l_partkey % 5) END AS author, ['high', 'medium', 'low'][l_linenumber % 3 + 1] AS confidence,
        CASE WHEN l_linenumber % 2 = 0 THEN 'rules' ELSE 'local' END AS engine FROM lineitem)"""


def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each group of pieces."""
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("group_key"), (F.lit(380) + F.col("s_suppkey") % 50).cast("long").alias("pages"))


SIZES_SQL = "sizes AS (SELECT 's' || s_suppkey AS group_key, CAST(380 + s_suppkey % 50 AS BIGINT) AS pages FROM supplier)"

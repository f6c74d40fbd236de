"""Folders as frames: listing, admission and scan, with Spark's own file source.

Listing a folder reads names and sizes only. Contents are read just for files whose size or time
differs from what is known; a file that cannot be read is a row of its own, and the rest go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import admission

#: A folder that holds a file of this name is a project's output.
MARKER = "project.json"


def decision(name: Column, head: Column, categories: tuple[str, ...] = ()) -> Column:
    """Why a file must not be indexed: by its name first, then by its first bytes; null if it may be, or where head is null."""
    start = F.substring(head, 1, admission.HEAD_BYTES)
    by_content = F.when(admission.has_private_key(start), "secret").when(admission.category(admission.extension(name)).isNull() & admission.looks_binary(start), "binary")
    return F.coalesce(admission.name_decision(name, categories), F.when(head.isNotNull(), by_content))


def listing(spark: SparkSession, base: str) -> DataFrame:
    """relative_path, size, mtime of the files below base, without system files and without folders of projects' output.

    Spark's file source lists neither hidden names ("." or "_" in front) nor empty files, which have
    nothing to index.
    """
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    qualified = root.makeQualified(system.getUri(), system.getWorkingDirectory()).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    inside = F.regexp_replace(F.col("path"), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    found = files.withColumn("relative_path", inside.substr(F.lit(len(qualified) + 2), F.length(inside)))
    name = F.element_at(F.split("relative_path", "/"), -1)
    found = found.filter(~F.coalesce(admission.name_decision(name) == "system", F.lit(False)))
    # every folder above a file, against the folders that hold a marker: equality, no prefix scan
    marked = found.filter(name == MARKER).select(F.regexp_replace("relative_path", "/?[^/]+$", "").alias("folder")).distinct()
    parts = F.split("relative_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    output = found.select("relative_path", F.explode(above).alias("folder")).filter("folder <> ''").join(marked.filter("folder <> ''"), "folder", "left_semi").select("relative_path").distinct()
    return found.join(output, "relative_path", "left_anti").select("relative_path", "size", "mtime", "path")


def scan(spark: SparkSession, base: str, known: DataFrame, categories: tuple[str, ...] = ()) -> DataFrame:
    """relative_path, status, reason: the folder against what is known (relative_path, size, mtime, sha256).

    refused: admission said why (reason); unreadable: listed, but its content could not be read; else
    as admission.inventory. Only files that differ in size or time are read.
    """
    files = listing(spark, base)
    old = known.select("relative_path", F.col("size").alias("s"), F.col("mtime").alias("m"), F.col("sha256").alias("h"))
    seen = files.join(old, "relative_path", "left")
    same = (F.col("size") == F.col("s")) & (F.col("mtime") == F.col("m"))
    fresh = seen.filter(~F.coalesce(same, F.lit(False))).select("relative_path", "size", "mtime", "path")
    contents = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(base)
    read = contents.select("path", F.sha2("content", 256).alias("sha256"), F.substring("content", 1, admission.HEAD_BYTES).alias("head")).join(fresh.select("path"), "path", "left_semi")
    name = F.element_at(F.split("relative_path", "/"), -1)
    judged = fresh.join(read, "path", "left").withColumn("reason", decision(name, F.col("head"), categories))
    out_of = judged.filter("reason is not null or sha256 is null").select(
        "relative_path", F.when(F.col("reason").isNotNull(), "refused").otherwise("unreadable").alias("status"), "reason"
    )
    kept = seen.filter(same).select("relative_path", "size", "mtime", F.col("h").alias("sha256"))
    good = kept.unionByName(judged.filter("reason is null and sha256 is not null").select("relative_path", "size", "mtime", "sha256"))
    rest = admission.inventory(good, known.join(out_of.select("relative_path"), "relative_path", "left_anti"))
    return rest.select("relative_path", "status", F.lit(None).cast("string").alias("reason")).unionByName(out_of)

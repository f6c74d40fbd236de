"""Keeping derived tables true to the sources: what changed, and what that invalidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """relative_path, status of each path of either snapshot (relative_path, size, mtime, sha256)."""
    o = old.select(F.col("relative_path").alias("p"), F.col("size").alias("s"), F.col("mtime").alias("m"), F.col("sha256").alias("h"))
    status = (
        F.when(F.col("relative_path").isNull(), "removed").when(F.col("p").isNull(), "new").when((F.col("size") == F.col("s")) & (F.col("mtime") == F.col("m")), "unchanged")
        .when(F.col("sha256") == F.col("h"), "touched").otherwise("changed")
    )
    return new.join(o, new["relative_path"] == o["p"], "full_outer").select(F.coalesce("relative_path", "p").alias("relative_path"), status.alias("status"))


def without(rows: DataFrame, stale: DataFrame, key: list[str]) -> DataFrame:
    """rows whose key is in no stale row."""
    return rows.join(stale.select(*key).distinct(), key, "left_anti")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: one aggregation, no sort of a key's rows."""
    rest = [c for c in rows.columns if c not in [*key, *order]]
    return rows.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("x")).select(*key, *[f"x.{c}" for c in [*order, *rest]])


def tail(rows: DataFrame, order: str, since: int, limit: int) -> DataFrame:
    """The newest `limit` rows after `since`, oldest first."""
    return rows.filter(F.col(order) > since).orderBy(F.desc(order)).limit(limit).orderBy(order)


def answered(windows: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """windows with status done where a line names them."""
    done = lines.select(key).distinct().withColumn("__done", F.lit(True))
    return windows.join(done, key, "left").withColumn("status", F.when(F.col("__done"), "done").otherwise("pending")).drop("__done")


def append_once(spark, frame: DataFrame, path: str, key: list[str]) -> int:
    """Appends the rows of frame whose key the table at path lacks; returns how many. Running it again adds nothing."""
    from pyspark.errors import AnalysisException

    try:
        fresh = frame.join(spark.read.parquet(path).select(*key).distinct(), key, "left_anti")
    except AnalysisException:
        fresh = frame
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


class StalePlanError(RuntimeError):
    """The sources changed after the plan was made."""


def fingerprint(listing: DataFrame) -> str:
    """Of all (relative_path, size, mtime): a sum of hashes, so that no list is gathered."""
    line = F.concat_ws(":", "relative_path", "size", "mtime")
    row = listing.agg(F.count("*").alias("n"), F.sum(F.xxhash64(line).cast("decimal(20,0)")).alias("s")).first()
    return f"{row['n']}:{row['s'] or 0}"


def apply_plan(tables: dict[str, DataFrame], stale: DataFrame, key: dict[str, list[str]], planned: str, listing: DataFrame) -> dict[str, DataFrame]:
    """tables without the rows of stale files; refuses if the listing is no longer the one that was planned for.

    key: the columns that name a file in each table. Nothing is written: the caller swaps all tables at once.
    """
    if fingerprint(listing) != planned:
        raise StalePlanError("the sources changed since the plan was made; plan again")
    return {name: without(frame, stale, key[name]) if name in key else frame for name, frame in tables.items()}


def replaced(spark, frame: DataFrame, path: str) -> None:
    """The table at path becomes frame, which may be made from it: written beside it first, then renamed into its place.

    A failure before the renames leaves the old table; one between them leaves it under path with .old.
    """
    make = spark._jvm.org.apache.hadoop.fs.Path
    here, new, old = make(path), make(f"{path}.new"), make(f"{path}.old")
    system = here.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not system.exists(here) and system.exists(old):
        system.rename(old, here)
    frame.write.mode("overwrite").parquet(f"{path}.new")
    system.delete(old, True)
    if system.exists(here):
        system.rename(here, old)
    system.rename(new, here)
    system.delete(old, True)


def rebuilt_once(spark, path: str, revision: int, build) -> bool:
    """Writes build() to path unless the table there has this revision already; returns whether it built."""
    from pyspark.errors import AnalysisException

    try:
        if not spark.read.parquet(path).filter(F.col("revision") == revision).isEmpty():
            return False
    except AnalysisException:
        pass
    replaced(spark, build().withColumn("revision", F.lit(revision)), path)
    return True

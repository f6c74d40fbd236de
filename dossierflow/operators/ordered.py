"""Order-dependent operators that do not need a whole group in one task.

Rows are range-partitioned by group and order into blocks, each block is scanned by itself,
and what a block must know of those before it (counts, running extremes, the last row) is a
few numbers for each block and group. So a group that holds a third of all rows spreads over
as many tasks as its rows need.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shared_folder(df: DataFrame) -> str:
    """The checkpoint folder that the cluster names.

    Where none is named, a single machine uses a temporary folder of its own; a cluster gets an
    error, since each executor would write to a disk that is lost with it.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def blocked(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df in blocks of a total order, with column `block`; fixed by a checkpoint, so that later reads see the same blocks."""
    shared_folder(df)
    return df.repartitionByRange(*group, *order).withColumn("block", F.spark_partition_id()).checkpoint()


def _carried(summaries: DataFrame, group: list[str], columns: dict[str, Column]) -> DataFrame:
    """For each block and group, columns over the group's earlier blocks. summaries: one row for each block and group."""
    before = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return summaries.select(*group, "block", *[c.over(before).alias(k) for k, c in columns.items()])


def positions(df: DataFrame, group: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """df with the row's place (from 1) in the order of its group."""
    rows = blocked(df, group, order)
    carried = _carried(rows.groupBy(*group, "block").agg(F.count("*").alias("n")), group, {"__before": F.sum("n")})
    own = F.row_number().over(Window.partitionBy("block", *group).orderBy(*order))
    return _joined(rows.withColumn("__own", own), carried, group).withColumn(name, (F.col("__own") + F.coalesce("__before", F.lit(0))).cast("long")).drop("block", "__own", "__before")


def _joined(rows: DataFrame, carried: DataFrame, group: list[str]) -> DataFrame:
    right = carried.select(*[F.col(c).alias(f"__{c}") for c in [*group, "block"]], *[c for c in carried.columns if c not in [*group, "block"]])
    match = rows["block"] == right["__block"]
    for c in group:
        match = match & rows[c].eqNullSafe(right[f"__{c}"])
    return rows.join(right, match, "left").drop(*[f"__{c}" for c in [*group, "block"]])


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, name: str, exclusive: bool = False) -> DataFrame:
    """df with the running sum of value in the order of its group."""
    rows = blocked(df, group, order)
    carried = _carried(rows.groupBy(*group, "block").agg(F.sum(value).alias("n")), group, {"__before": F.sum("n")})
    own = F.sum(value).over(Window.partitionBy("block", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0))
    return _joined(rows.withColumn("__own", own), carried, group).withColumn(name, F.coalesce("__own", F.lit(0)) + F.coalesce("__before", F.lit(0))).drop("block", "__own", "__before")


def previous(df: DataFrame, group: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """df with the values that columns (new name: column) have in the row before."""
    rows = blocked(df, group, order)
    values = F.struct(*[F.col(c).alias(f"v{k}") for k, c in enumerate(columns.values())])
    ends = rows.groupBy(*group, "block").agg(F.max_by(values, F.struct(*order)).alias("end"))
    carried = _carried(ends, group, {"end": F.last("end")})
    inside = F.lag(values).over(Window.partitionBy("block", *group).orderBy(*order))
    joined = _joined(rows.withColumn("inside", inside), carried, group)
    got = F.coalesce("inside", "end")
    return joined.withColumns({name: got[f"v{k}"] for k, name in enumerate(columns)}).drop("block", "inside", "end")


def islands(df: DataFrame, group: list[str], order: list[str], opens: Column, needs: dict[str, str], name: str = "island") -> DataFrame:
    """df numbered by runs; opens is true for the first row of a run and may use columns of the row before (needs)."""
    flagged = previous(df, group, order, needs).withColumn("__opens", F.coalesce(opens, F.lit(True)).cast("long")).drop(*needs)
    return running_sum(flagged, group, order, "__opens", name).drop("__opens")

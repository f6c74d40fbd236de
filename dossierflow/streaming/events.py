"""The event log and the search index as streams."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import ordered


def hourly(spark: SparkSession, path: str) -> DataFrame:
    """hour, event_type, n: the log at path read with availableNow, and its counts written by a stream.

    The sink is a table in the shared folder, written a batch at a time under the batch's
    number, so a batch that runs again replaces its own rows.
    """
    schema = spark.read.parquet(path).schema
    ordered.shared_folder(spark.range(0))
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).parquet(f"{path}*" if not path.endswith("*") else path)
    counts = stream.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    run = counts.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    last = out.agg(F.max("batch")).first()[0]
    return out.filter(F.col("batch") == last).select("hour", "event_type", "n")


#: Share of a new estimate that reaches the reader; seconds and part of the work before there is one.
SMOOTHING, LEAST_SECONDS, LEAST_PART = 0.35, 4.0, 0.005


def progress(stream: DataFrame, tau: float = 45.0, stall: float = 180.0) -> DataFrame:
    """run, done, rate, remaining, stalled for each run, updated as (run, at, done, total) rows arrive.

    An advance is measured from the last advance, not from the last reading: a reading that sees
    none says nothing about the pace. The rate's memory fades with exp(-seconds / tau); it is blended
    with the mean since the start, which counts for more the longer the run has gone on. remaining is
    null until there is something to go by, once all is done, and where nothing has advanced for more
    than `stall` seconds, which also forgets the rate.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, moved, done, rate, shown = state.get if state.exists else (None, None, 0.0, None, None)
        stalled, remaining = False, None
        for row in pd.concat(list(frames)).sort_values(["at", "done"]).itertuples():
            at, now_done, total = float(row.at), float(row.done), float(row.total)
            remaining = None
            if started is None:
                started, moved, done = at, at, now_done
                continue
            if now_done > done and at > moved:
                gap = at - moved
                own, weight = (now_done - done) / gap, 1.0 - math.exp(-gap / tau)
                rate = own if rate is None else weight * own + (1.0 - weight) * rate
                moved, done, stalled = at, now_done, False
            elif at - moved > stall:
                rate, shown, stalled = None, None, True
            spent = at - started
            if rate and spent >= LEAST_SECONDS and total * LEAST_PART <= now_done < total:
                part = min(0.8, spent / (spent + 4 * tau))
                estimate = (total - now_done) / (part * now_done / spent + (1.0 - part) * rate)
                remaining = shown = estimate if shown is None else SMOOTHING * estimate + (1.0 - SMOOTHING) * shown
        state.update((started, moved, done, rate, shown))
        yield pd.DataFrame({"run": [key[0]], "done": [done], "rate": pd.Series([rate], dtype="float64"), "remaining": pd.Series([remaining], dtype="float64"), "stalled": [stalled]})

    schema = "run string, done double, rate double, remaining double, stalled boolean"
    return stream.groupBy("run").applyInPandasWithState(update, schema, "started double, moved double, done double, rate double, shown double", "update", GroupStateTimeout.NoTimeout)

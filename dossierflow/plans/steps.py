"""The steps of a run: functions from named tables to named tables, with a row of the run log for each."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

Tables = dict[str, DataFrame]
Step = Callable[[Tables], Tables]
STEPS: dict[str, Step] = {}
RUN = "step string, started_at timestamp, seconds double, ok boolean, error string"


def step(name: str) -> Callable[[Step], Step]:
    def add(function: Step) -> Step:
        STEPS[name] = function
        return function

    return add


def run(spark: SparkSession, tables: Tables, names: list[str], log_path: str | None = None) -> Tables:
    """tables after the named steps, in order; a step that fails is logged and ends the run."""
    log, held = [], dict(tables)
    try:
        for name in names:
            began, at = time.time(), datetime.now(timezone.utc)
            try:
                held |= STEPS[name](held)
            except Exception as error:
                log.append((name, at, time.time() - began, False, f"{type(error).__name__}: {error}"[:500]))
                raise
            log.append((name, at, time.time() - began, True, None))
    finally:
        if log_path:
            spark.createDataFrame(log, RUN).coalesce(1).write.mode("append").parquet(log_path)
    return held


@step("inventory")
def _inventory(tables: Tables) -> Tables:
    from ..sources import admission

    return {"file": admission.inventory(tables["listing"], tables["file"])}


@step("extraction")
def _extraction(tables: Tables) -> Tables:
    from ..sources import readers

    return {"page": readers.read_pages(tables["source"])}


@step("windows")
def _windows(tables: Tables) -> Tables:
    from pyspark.sql import functions as F

    from .piece_queries import _spans

    return {"window": _spans(tables["page"].groupBy("group_key").agg(F.count("*").alias("pages")))}


@step("consolidation")
def _consolidation(tables: Tables) -> Tables:
    from ..operators import pieces

    return {"item": pieces.trimmed(tables["raw_item"])}

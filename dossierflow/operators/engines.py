"""Pluggable engines: a Python object that turns the pages of one window into pieces."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PAGES = ["pos", "file", "text"]
ITEMS = T.StructType([
    T.StructField("group_key", T.StringType()), T.StructField("start_pos", T.LongType()), T.StructField("start_order", T.LongType()), T.StructField("end_order", T.LongType()),
    T.StructField("type", T.StringType()), T.StructField("date", T.StringType()), T.StructField("summary", T.StringType()), T.StructField("confidence", T.StringType()),
])


class Engine(Protocol):
    """classify gets the pages of a window in order (dicts of PAGES) and returns dicts of ITEMS without the window's columns."""

    def classify(self, pages: list[dict]) -> list[dict]: ...


def run(pages: DataFrame, engine: Engine) -> DataFrame:
    """Pieces of every window of pages (group_key, start_pos, pos, file, text); a window has a fixed number of pages."""

    def one(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        found = engine.classify(own.sort_values("pos")[PAGES].to_dict("records"))
        rows = [{"group_key": key[0], "start_pos": key[1], **item} for item in found]
        return pd.DataFrame(rows, columns=ITEMS.names)

    return pages.select("group_key", "start_pos", *PAGES).groupBy("group_key", "start_pos").applyInPandas(one, ITEMS)


def with_fallback(first: Engine, second: Engine) -> Engine:
    """An engine that halves a window until the first engine copes, and asks the second one for single pages that it cannot read."""

    class Both:
        def classify(self, pages: list[dict]) -> list[dict]:
            try:
                return first.classify(pages)
            except ValueError:
                if len(pages) < 2:
                    return [{**item, "confidence": "low"} for item in second.classify(pages)]
                half = len(pages) // 2
                return self.classify(pages[:half]) + self.classify(pages[half:])

    return Both()

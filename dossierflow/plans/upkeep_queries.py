"""Queries on incremental upkeep (T), sinks (K) and the steps of the pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import upkeep
from ..sources import collection
from ..sources.collection import FILES_SQL, ITEMS_SQL, PAGES_SQL, table
from .registry import query
from .source_queries import _SNAPSHOT, _snapshots


@query(f"""WITH {FILES_SQL}, {_SNAPSHOT} SELECT coalesce(n.relative_path, o.relative_path) AS relative_path, CASE WHEN n.relative_path IS NULL THEN 'removed' WHEN o.relative_path IS NULL THEN 'new'
    WHEN n.size = o.size AND n.mtime = o.mtime THEN 'unchanged' WHEN n.sha256 = o.sha256 THEN 'touched' ELSE 'changed' END AS status FROM new n FULL JOIN old o ON n.relative_path = o.relative_path""")
def j9_change_detection(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return upkeep.changes(old, new)


@query(f"""WITH {PAGES_SQL}, gone AS (SELECT DISTINCT file_id FROM pages_ WHERE file_id % 5 = 0) SELECT file_id, number FROM pages_ WHERE file_id NOT IN (SELECT file_id FROM gone)""")
def t4_cascade_invalidation(spark, sf_dir):
    pages = collection.pages(spark, sf_dir)
    return upkeep.without(pages, pages.filter(F.col("file_id") % 5 == 0), ["file_id"]).select("file_id", "number")


@query(f"""WITH {FILES_SQL} SELECT extension, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, max(file_id) AS newest FROM files GROUP BY extension""")
def t10_artifact_state(spark, sf_dir):
    return collection.files(spark, sf_dir).groupBy("extension").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("file_id").alias("newest"))


@query("SELECT event_id, event_type, ts FROM (SELECT * FROM events WHERE event_id > 100 AND event_type = 'error' ORDER BY event_id DESC LIMIT 20) ORDER BY event_id")
def t13_event_tail(spark, sf_dir):
    return upkeep.tail(table(spark, sf_dir, "events").filter("event_type = 'error'"), "event_id", 100, 20).select("event_id", "event_type", "ts")


@query(f"""WITH {ITEMS_SQL}, w AS (SELECT line, group_key, 's' || (line % 40) AS win FROM items) SELECT line FROM w WHERE win NOT IN (SELECT 's' || (i * 7) FROM range(6) t(i)) AND group_key NOT IN ('s1', 's3')""")
def t16_prune_raw_items(spark, sf_dir):
    rows = collection.items(spark, sf_dir).select("line", "group_key", F.concat(F.lit("s"), F.col("line") % 40).alias("win"))
    keys = spark.createDataFrame([(f"s{k * 7}",) for k in range(6)], "win string")
    groups = spark.createDataFrame([("s1",), ("s3",)], "group_key string")
    return upkeep.without(upkeep.without(rows, keys, ["win"]), groups, ["group_key"]).select("line")


@query("SELECT o_orderkey AS win, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 5) THEN 'done' ELSE 'pending' END AS status FROM orders")
def t20_answered_windows(spark, sf_dir):
    windows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("win"))
    return upkeep.answered(windows, table(spark, sf_dir, "lineitem").filter("l_linenumber = 5").select(F.col("l_orderkey").alias("win")), "win")


@query("SELECT DISTINCT user_id AS win FROM events WHERE event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0")
def t21_failed_windows(spark, sf_dir):
    failed = table(spark, sf_dir, "events").filter("event_type = 'error'").select("user_id", F.from_json("props", "k bigint")["k"].alias("k"))
    return failed.filter("k % 2 = 0").select(F.col("user_id").alias("win")).distinct()


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def k22_latest_removal(spark, sf_dir):
    return upkeep.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"])


@query(f"""WITH {ITEMS_SQL}, d AS (SELECT group_key, start_order, line, date, count(*) OVER (PARTITION BY group_key) > 580 AS own_file FROM items WHERE date IS NOT NULL) SELECT group_key, start_order, line, date, own_file FROM d ORDER BY date, group_key, start_order, line""")
def k7_timeline(spark, sf_dir):
    dated = collection.items(spark, sf_dir).filter("date is not null").select("group_key", "start_order", "line", "date")
    counts = dated.groupBy("group_key").agg((F.count("*") > 580).alias("own_file"))
    return dated.join(counts, "group_key").orderBy("date", "group_key", "start_order", "line")


@query(f"""WITH {ITEMS_SQL}, n AS (SELECT type AS kind, line % 50 AS number, date, group_key, start_order FROM items WHERE type IS NOT NULL)
SELECT kind, number, date, count(*) AS cited, list_sort(list(DISTINCT group_key)) AS groups, min(start_order) AS first_page FROM n GROUP BY kind, number, date""")
def k9_cited_norms(spark, sf_dir):
    rows = collection.items(spark, sf_dir).filter("type is not null").select(F.col("type").alias("kind"), (F.col("line") % 50).alias("number"), "date", "group_key", "start_order")
    return rows.groupBy("kind", "number", "date").agg(F.count("*").alias("cited"), F.array_sort(F.collect_set("group_key")).alias("groups"), F.min("start_order").alias("first_page"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def t7_events_by_hour(spark, sf_dir):
    """The event log read as a stream, all that is available, into an hourly count."""
    from ..streaming import events

    return events.hourly(spark, f"{sf_dir}/events.parquet")

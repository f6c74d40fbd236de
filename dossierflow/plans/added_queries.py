"""Queries on admission, life cycles, retries, events and subsets, each through its library operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle, upkeep
from ..sources import collection, folder
from ..sources.collection import FILES_SQL, ITEMS_SQL, table
from .registry import query

_HEADS = """h AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a' || doc_id || '.txt' WHEN 1 THEN 'b' || doc_id || '.xyz' WHEN 2 THEN 'c' || doc_id || '.pem' ELSE 'noext' || doc_id END AS name,
    CASE doc_id % 5 WHEN 0 THEN 'x -----BEGIN RSA PRIVATE KEY----- y' WHEN 1 THEN repeat(chr(1), 50) || 'abc' WHEN 2 THEN NULL ELSE 'plain text' END AS head FROM documents)"""


@query(f"""WITH {_HEADS} SELECT doc_id, CASE WHEN name LIKE '%.pem' THEN 'secret' WHEN head LIKE '%PRIVATE KEY-----%' THEN 'secret' WHEN name NOT LIKE '%.txt' AND head LIKE chr(1) || '%' THEN 'binary' END AS reason FROM h""")
def s6_index_decision(spark, sf_dir):
    k = F.col("doc_id")
    name = F.when(k % 4 == 0, F.concat(F.lit("a"), k, F.lit(".txt"))).when(k % 4 == 1, F.concat(F.lit("b"), k, F.lit(".xyz"))).when(k % 4 == 2, F.concat(F.lit("c"), k, F.lit(".pem"))).otherwise(F.concat(F.lit("noext"), k))
    head = F.when(k % 5 == 0, "x -----BEGIN RSA PRIVATE KEY----- y").when(k % 5 == 1, F.concat(F.repeat(F.lit("\x01"), 50), F.lit("abc"))).when(k % 5 > 2, "plain text")
    return table(spark, sf_dir, "documents").select("doc_id", folder.decision(name, head.cast("binary")).alias("reason"))


_PAIR = f"""{FILES_SQL}, old AS (SELECT relative_path, sha256 FROM files WHERE file_id % 10 <> 0), new AS (SELECT relative_path, CASE WHEN file_id % 4 = 1 THEN 'other' ELSE sha256 END AS sha256 FROM files WHERE file_id % 7 <> 0)"""


def _snapshots(spark, sf_dir):
    files = collection.files(spark, sf_dir).select("file_id", "relative_path", "size", "sha256")
    row = lambda df, h, m: df.select("relative_path", "size", F.lit(m).alias("mtime"), h.alias("sha256"))
    changed = F.when(F.col("file_id") % 4 == 1, "other").otherwise(F.col("sha256"))
    return files, row(files.filter("file_id % 10 <> 0"), F.col("sha256"), 1.0), row(files.filter("file_id % 7 <> 0"), changed, 2.0)


@query(f"""WITH {_PAIR} SELECT f.relative_path FROM files f WHERE NOT EXISTS (SELECT 1 FROM old JOIN new USING (relative_path) WHERE relative_path = f.relative_path AND old.sha256 <> new.sha256)""")
def t5_apply_changed_only(spark, sf_dir):
    """Rows of changed files go; those of removed files stay until someone says so."""
    files, old, new = _snapshots(spark, sf_dir)
    return lifecycle.apply_pending({"page": files.select("relative_path")}, upkeep.changes(old, new), {"page": ["relative_path"]})["page"]


@query(f"""WITH {FILES_SQL} SELECT file_id FROM files WHERE relative_path <> (SELECT min(relative_path) FROM files)""")
def t6_discard_file(spark, sf_dir):
    files = collection.files(spark, sf_dir).select("file_id", "relative_path")
    first = files.agg(F.min("relative_path")).first()[0]
    return lifecycle.discard_file({"page": files}, first, {"page": "relative_path"})["page"].select("file_id")


@query(f"""WITH {FILES_SQL} SELECT relative_path, CAST(CASE WHEN file_id % 5 = 0 THEN 0 WHEN file_id % 3 = 0 THEN 0 WHEN file_id % 3 = 1 THEN file_id % 5 ELSE least(file_id % 5, 2) END AS BIGINT) AS pages FROM files""")
def t12_resume_point(spark, sf_dir):
    """Pages that a broken run left: none for every third file, which has changed since; for another third the third page is missing."""
    files = collection.files(spark, sf_dir).select("file_id", "relative_path", "size")
    listing = files.select("relative_path", "size", F.lit(1.0).alias("mtime"))
    pages = files.filter("file_id % 5 > 0").withColumn("number", F.explode(F.sequence(F.lit(1), (F.col("file_id") % 5).cast("int"))))
    progress = pages.filter("not (file_id % 3 = 2 and number = 3)").select("relative_path", "size", F.when(F.col("file_id") % 3 == 0, 0.5).otherwise(1.0).alias("mtime"), "number")
    return lifecycle.resume_point(progress, listing)


@query("""SELECT doc_id AS file_id, CASE WHEN doc_id % 4 = 0 THEN 'held_back' ELSE 'requeue' END AS retry FROM documents WHERE doc_id % 3 = 0 AND doc_id % 4 < 2""")
def p23_ocr_retry(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ["extracted", "failed", "discovered", "skipped"])), (F.col("doc_id") % 4 + 1).cast("int"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), status.alias("status"), (F.col("doc_id") % 3 == 0).alias("ocr_failed"))
    return lifecycle.retry_of(files, table(spark, sf_dir, "conversations"), ["extracted", "failed"])


@query("""SELECT event_id, 'read' AS step, 'info' AS level, 'event.seen' AS message_key, '{"kind":"' || event_type || '","user":"' || user_id || '"}' AS message_params, 'user ' || user_id || ' did ' || event_type AS message FROM events""")
def k14_event_rows(spark, sf_dir):
    params = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", *lifecycle.event("read", "info", "event.seen", params, "user {user} did {kind}"))


@query()
def w21_language_chunks(spark, sf_dir):
    """Chunks of the whole documents; a fold with resets, checked against a loop in the tests."""
    return lifecycle.language_chunks(table(spark, sf_dir, "documents"))


@query(f"""WITH {ITEMS_SQL}, k AS (SELECT group_key, start_order, min(coalesce(type, '')) AS type, min(date) AS date FROM items WHERE line % 9 = 0 GROUP BY ALL), i AS (SELECT group_key, start_order, min(coalesce(type, '')) AS t, min(date) AS d FROM items WHERE line % 9 <> 0 GROUP BY ALL)
SELECT group_key, count(*) AS key_pieces, count(i.t) AS matched, count(*) FILTER (k.type = i.t) AS type_hits, count(k.date) FILTER (i.t IS NOT NULL) AS dated, count(*) FILTER (k.date = i.d) AS date_hits FROM k LEFT JOIN i USING (group_key, start_order) GROUP BY group_key""")
def a31_subset_accuracy(spark, sf_dir):
    """Accuracy counts of each group as a subset of all: conditional sums over matched places."""
    items = collection.items(spark, sf_dir).withColumn("type", F.coalesce("type", F.lit("")))
    place = ["group_key", "start_order"]
    key = items.filter("line % 9 = 0").groupBy(*place).agg(F.min("type").alias("type"), F.min("date").alias("date"))
    index = items.filter("line % 9 <> 0").groupBy(*place).agg(F.min("type").alias("t"), F.min("date").alias("d"))
    counts = {"key_pieces": F.count("*"), "matched": F.count("t"), "type_hits": F.count_if(F.col("type") == F.col("t")), "dated": F.count(F.when(F.col("t").isNotNull(), F.col("date"))), "date_hits": F.count_if(F.col("date") == F.col("d"))}
    return key.join(index, place, "left").groupBy("group_key").agg(*[c.alias(n) for n, c in counts.items()])


@query(f"""WITH {FILES_SQL} SELECT file_id, size FROM files WHERE language = 'de' ORDER BY size DESC, file_id LIMIT 50""")
def o7_filter_then_top(spark, sf_dir):
    """The filter stands below the limit, so nothing has to be fetched in excess."""
    return collection.files(spark, sf_dir).filter("language = 'de'").orderBy(F.desc("size"), "file_id").limit(50).select("file_id", "size")


@query(f"""WITH {FILES_SQL}, r AS (SELECT file_id, size, row_number() OVER (ORDER BY size DESC, file_id) AS r, count(*) OVER () AS n FROM files) SELECT file_id, size FROM r WHERE r <= 20""")
def o6_largest_first(spark, sf_dir):
    """What a queue of heavy files takes first: the twenty largest."""
    return collection.files(spark, sf_dir).select("file_id", "size").orderBy(F.desc("size"), "file_id").limit(20)

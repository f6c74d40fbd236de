"""Queries on pieces, pages and windows (W, J, A)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import ordered, pieces
from ..sources import collection
from ..sources.collection import FILES_SQL, ITEMS_SQL, PAGES_SQL, SIZES_SQL, table
from .registry import query

# --- windows ---------------------------------------------------------------------------------


@query(f"WITH {PAGES_SQL} SELECT group_key, path, number, row_number() OVER (PARTITION BY group_key ORDER BY file_id, number) AS pos FROM pages_")
def w1_group_positions(spark, sf_dir):
    rows = collection.pages(spark, sf_dir).withColumn("key", t.natural_key(F.col("path")))
    return ordered.positions(rows, ["group_key"], ["key", "number"]).select("group_key", "path", "number", "pos")


@query(f"""WITH {PAGES_SQL}, c AS (SELECT group_key, file_id, count(*) AS n FROM pages_ GROUP BY ALL)
SELECT group_key, file_id, n, CAST(coalesce(sum(n) OVER (PARTITION BY group_key ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM c""")
def w2_running_sheets(spark, sf_dir):
    counts = collection.pages(spark, sf_dir).groupBy("group_key", "file_id").agg(F.count("*").alias("n"))
    return ordered.running_sum(counts, ["group_key"], ["file_id"], "n", "before", exclusive=True).select("group_key", "file_id", "n", F.col("before").cast("long"))


def _spans(sizes, size=16, overlap=2):
    """Overlapping windows of a group's positions; none for an empty group."""
    step = max(1, size - overlap)
    last = F.greatest(F.lit(0), F.ceil((F.col("pages") - size) / step))
    starts = F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda i: i * step)
    rows = sizes.filter("pages > 0").select("group_key", "pages", F.explode(starts).alias("s"))
    return rows.select("group_key", (F.col("s") + 1).alias("start_pos"), F.least(F.col("s") + size, F.col("pages")).alias("end_pos"))


_SPANS_SQL = "spans AS (SELECT group_key, s + 1 AS start_pos, least(s + 16, pages) AS end_pos FROM (SELECT group_key, pages, unnest(range(0, CAST(greatest(0, ceil((pages - 16) / 14.0)) AS BIGINT) * 14 + 1, 14)) AS s FROM sizes WHERE pages > 0))"


@query(f"WITH {SIZES_SQL}, {_SPANS_SQL} SELECT group_key, start_pos, end_pos, format('{{}}::{{:06d}}-{{:06d}}', group_key, start_pos, end_pos) AS key FROM spans")
def w3_page_windows(spark, sf_dir):
    return _spans(collection.group_sizes(spark, sf_dir)).withColumn("key", t.window_key(F.col("group_key"), F.col("start_pos"), F.col("end_pos")))


@query(f"WITH {SIZES_SQL}, {_SPANS_SQL} SELECT group_key, start_pos, end_pos FROM spans WHERE start_pos % 3 <> 0")
def w4_missing_windows(spark, sf_dir):
    spans = _spans(collection.group_sizes(spark, sf_dir))
    return spans.join(spans.filter(F.col("start_pos") % 3 == 0), ["group_key", "start_pos", "end_pos"], "left_anti")


@query(f"""WITH {PAGES_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY file_id, number) AS pos FROM pages_), sizes AS (SELECT group_key, count(*) AS pages FROM pages_ GROUP BY group_key), {_SPANS_SQL}
SELECT s.group_key, s.start_pos, p.pos, p.path, p.number FROM spans s JOIN p ON s.group_key = p.group_key AND p.pos BETWEEN s.start_pos AND s.end_pos""")
def w5_window_pages(spark, sf_dir):
    rows = collection.pages(spark, sf_dir).withColumn("key", t.natural_key(F.col("path")))
    places = ordered.positions(rows, ["group_key"], ["key", "number"])
    spans = _spans(places.groupBy("group_key").agg(F.count("*").alias("pages")))
    spots = spans.select("group_key", "start_pos", F.explode(F.sequence("start_pos", "end_pos")).alias("pos"))
    return spots.join(places, ["group_key", "pos"]).select("group_key", "start_pos", "pos", "path", "number")


@query(f"""WITH {ITEMS_SQL}, {SIZES_SQL}, m AS (SELECT group_key, unnest(range(1, pages + 1)) AS pos FROM sizes EXCEPT SELECT group_key, unnest(range(start_order, end_order + 1)) FROM items),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY group_key ORDER BY pos) AS k FROM m) SELECT group_key, min(pos) AS first, max(pos) AS last FROM r GROUP BY group_key, k""")
def w7_gaps(spark, sf_dir):
    return pieces.gaps(collection.items(spark, sf_dir), collection.group_sizes(spark, sf_dir))


@query(f"""WITH {ITEMS_SQL}, {SIZES_SQL}, s AS (SELECT i.group_key, confidence, unnest(range(greatest(start_order, 1), least(end_order, pages) + 1)) AS pos FROM items i JOIN sizes USING (group_key)),
d AS (SELECT group_key, pos, bool_or(confidence <> 'low') AS sure FROM s GROUP BY ALL), c AS (SELECT group_key, count(*) AS covered, count(*) FILTER (sure) AS classified FROM d GROUP BY group_key)
SELECT group_key, pages, coalesce(covered, 0) AS covered, coalesce(classified, 0) AS classified FROM sizes LEFT JOIN c USING (group_key)""")
def w8_coverage_sweep(spark, sf_dir):
    return pieces.covered_pages(collection.items(spark, sf_dir), collection.group_sizes(spark, sf_dir))


_CONF = "array_position(['low', 'medium', 'high'], {})"
# some lines share a number: ties go by the fields, nulls first
_ORDERED = """o AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY start_order, end_order, line, type NULLS FIRST, date NULLS FIRST, author NULLS FIRST, confidence) AS rn FROM items)"""


@query(f"""WITH RECURSIVE {ITEMS_SQL}, {_ORDERED}, f AS (
    SELECT group_key, rn, 1 AS piece, start_order, end_order, type, date, author, confidence, CAST(1 AS BIGINT) AS lines FROM o WHERE rn = 1
    UNION ALL
    SELECT o.group_key, o.rn, f.piece + CASE WHEN fits THEN 0 ELSE 1 END, CASE WHEN fits THEN least(o.start_order, f.start_order) ELSE o.start_order END,
        CASE WHEN fits THEN greatest(o.end_order, f.end_order) ELSE o.end_order END,
        CASE WHEN NOT fits THEN o.type WHEN better THEN coalesce(o.type, f.type) ELSE coalesce(f.type, o.type) END,
        CASE WHEN NOT fits THEN o.date WHEN better THEN coalesce(o.date, f.date) ELSE coalesce(f.date, o.date) END,
        CASE WHEN NOT fits THEN o.author WHEN better THEN coalesce(o.author, f.author) ELSE coalesce(f.author, o.author) END,
        CASE WHEN NOT fits OR better THEN o.confidence ELSE f.confidence END, CASE WHEN fits THEN f.lines + 1 ELSE 1 END
    FROM f JOIN o ON o.group_key = f.group_key AND o.rn = f.rn + 1,
        LATERAL (SELECT o.start_order <= f.end_order AND (o.type IS NULL OR f.type IS NULL OR o.type = f.type) AS fits, {_CONF.format("o.confidence")} > {_CONF.format("f.confidence")} AS better))
SELECT group_key, start_order, end_order, type, date, author, confidence, lines FROM f QUALIFY row_number() OVER (PARTITION BY group_key, piece ORDER BY rn DESC) = 1""")
def w9_consolidate_pieces(spark, sf_dir):
    return pieces.consolidated(collection.items(spark, sf_dir))


@query(f"""WITH {PAGES_SQL}, f AS (SELECT group_key, file_id, number, role, row_number() OVER (PARTITION BY group_key ORDER BY file_id, number) AS pos, lag(file_id) OVER w AS pf, lag(role) OVER w AS pr FROM pages_ WINDOW w AS (PARTITION BY group_key ORDER BY file_id, number)),
r AS (SELECT *, sum(CASE WHEN pf IS DISTINCT FROM file_id OR (pr = 'assistant') <> (role = 'assistant') THEN 1 ELSE 0 END) OVER (PARTITION BY group_key ORDER BY pos) AS island FROM f)
SELECT group_key, CAST(island AS BIGINT) AS island, min(pos) AS first, max(pos) AS last, min(file_id) AS file_id FROM r GROUP BY group_key, island""")
def w11_runs_of_pages(spark, sf_dir):
    rows = ordered.positions(collection.pages(spark, sf_dir), ["group_key"], ["file_id", "number"])
    opens = ~F.col("pf").eqNullSafe(F.col("file_id")) | ((F.col("pr") == "assistant") != (F.col("role") == "assistant"))
    runs = ordered.islands(rows, ["group_key"], ["pos"], opens, {"pf": "file_id", "pr": "role"})
    return runs.groupBy("group_key", "island").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("file_id").alias("file_id"))


@query(f"""WITH {PAGES_SQL}, b AS (SELECT file_id, number, number - row_number() OVER (PARTITION BY file_id ORDER BY number) AS k FROM pages_ WHERE length(text) < 60)
SELECT file_id, min(number) AS first, max(number) AS last FROM b GROUP BY file_id, k""")
def w12_blank_runs(spark, sf_dir):
    rows = ordered.positions(collection.pages(spark, sf_dir).filter(F.length("text") < 60), ["file_id"], ["number"], "rn")
    return rows.groupBy("file_id", (F.col("number") - F.col("rn")).alias("k")).agg(F.min("number").alias("first"), F.max("number").alias("last")).drop("k")


@query(f"""WITH {PAGES_SQL}, stored AS (SELECT group_key, file_id, count(*) AS n FROM pages_ GROUP BY ALL), intended AS (SELECT * FROM stored WHERE file_id % 23 <> 5),
s AS (SELECT *, row_number() OVER w AS k, sum(n) OVER (PARTITION BY group_key ORDER BY file_id) - n AS before FROM stored WINDOW w AS (PARTITION BY group_key ORDER BY file_id)),
i AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY file_id) AS k FROM intended)
SELECT s.group_key, CAST(min(before) AS BIGINT) AS divergence FROM s LEFT JOIN i ON s.group_key = i.group_key AND s.k = i.k WHERE i.file_id IS DISTINCT FROM s.file_id GROUP BY s.group_key""")
def w14_divergence_page(spark, sf_dir):
    stored = collection.pages(spark, sf_dir).groupBy("group_key", "file_id").agg(F.count("*").alias("n"))
    s = ordered.running_sum(ordered.positions(stored, ["group_key"], ["file_id"], "k"), ["group_key"], ["file_id"], "n", "before", exclusive=True)
    i = ordered.positions(stored.filter(F.col("file_id") % 23 != 5), ["group_key"], ["file_id"], "k").select("group_key", "k", F.col("file_id").alias("meant"))
    return s.join(i, ["group_key", "k"], "left").filter(~F.col("meant").eqNullSafe(F.col("file_id"))).groupBy("group_key").agg(F.min("before").cast("long").alias("divergence"))


@query(f"""WITH {SIZES_SQL}, {_SPANS_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY start_pos) AS idx, max(end_pos) OVER (PARTITION BY group_key) AS top FROM spans)
SELECT group_key, coalesce(min(idx) FILTER (end_pos > 100), CASE WHEN max(end_pos - start_pos + 1) FILTER (end_pos = top) < 16 THEN max(idx) ELSE max(idx) + 1 END) AS first_affected FROM x GROUP BY group_key""")
def w15_first_affected_window(spark, sf_dir):
    spans = ordered.positions(_spans(collection.group_sizes(spark, sf_dir)), ["group_key"], ["start_pos"], "idx")
    last = F.max_by(F.col("end_pos") - F.col("start_pos") + 1, "idx")
    return spans.groupBy("group_key").agg(F.coalesce(F.min(F.when(F.col("end_pos") > 100, F.col("idx"))), F.when(last < 16, F.max("idx")).otherwise(F.max("idx") + 1)).alias("first_affected"))


@query("SELECT user_id, event_id, ts FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def w18_last_good_run(spark, sf_dir):
    runs = table(spark, sf_dir, "events").filter("event_type <> 'error'")
    return runs.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("x")).select("user_id", "x.event_id", "x.ts")


@query(f"""WITH {PAGES_SQL}, h AS (SELECT file_id, number, length(text) AS score FROM pages_), r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, number) AS r, max(score) OVER (PARTITION BY file_id) AS best FROM h)
SELECT file_id, number, score, r, best FROM r WHERE r <= 3 ORDER BY best DESC, file_id, r""")
def w19_best_per_file(spark, sf_dir):
    hits = collection.pages(spark, sf_dir).select("file_id", "number", F.length("text").alias("score"))
    ranked = hits.withColumn("r", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("score"), "number"))).filter("r <= 3")
    best = hits.groupBy("file_id").agg(F.max("score").alias("best"))
    return ranked.join(best, "file_id").orderBy(F.desc("best"), "file_id", "r")


@query(f"""WITH {SIZES_SQL} SELECT group_key, list_transform(range(0, 8), lambda i: CAST(floor(i * (pages - 1) / 7.0) AS BIGINT) + 1) AS sampled FROM sizes""")
def w24_spread_sample(spark, sf_dir):
    return collection.group_sizes(spark, sf_dir).select("group_key", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.floor(i * (F.col("pages") - 1) / 7.0) + 1).alias("sampled"))


# --- joins -----------------------------------------------------------------------------------


@query(f"WITH {PAGES_SQL}, f AS (SELECT DISTINCT conv_id, conv_id % 7 AS g FROM conversations) SELECT p.file_id, p.number, length(p.text) AS chars FROM pages_ p JOIN f ON p.file_id = f.conv_id WHERE g = 3")
def j1_pages_of_group(spark, sf_dir):
    pages = collection.pages(spark, sf_dir)
    files = pages.select("file_id", "group_key").distinct()
    return pages.drop("group_key").join(files.filter("group_key = 'g3'"), "file_id").select("file_id", "number", F.length("text").alias("chars"))


@query(f"""WITH {FILES_SQL}, once AS (SELECT size FROM files GROUP BY size HAVING count(*) = 1) SELECT file_id, files.size AS size FROM files JOIN once USING (size)""")
def j4_unambiguous_names(spark, sf_dir):
    files = collection.files(spark, sf_dir)
    return files.join(files.groupBy("size").agg(F.count("*").alias("n")).filter("n = 1").select("size"), "size", "left_semi").select("file_id", "size")


@query(f"WITH {FILES_SQL} SELECT file_id, count(c.conv_id) AS pages FROM files LEFT JOIN conversations c ON c.conv_id = file_id GROUP BY file_id")
def j5_stored_geometry(spark, sf_dir):
    pages = collection.pages(spark, sf_dir).groupBy("file_id").agg(F.count("*").alias("n"))
    return collection.files(spark, sf_dir).select("file_id").join(pages, "file_id", "left").select("file_id", F.coalesce("n", F.lit(0)).alias("pages"))


@query(f"WITH {FILES_SQL} SELECT file_id FROM files WHERE extension = 'pdf' AND file_id NOT IN (SELECT doc_id FROM labels)")
def j6_pending_files(spark, sf_dir):
    return collection.files(spark, sf_dir).filter("extension = 'pdf'").join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_id")), "file_id", "left_anti").select("file_id")


@query(f"WITH {FILES_SQL} SELECT relative_path FROM files WHERE extension <> 'pdf' AND EXISTS (SELECT 1 FROM labels WHERE doc_id = file_id)")
def j7_stale_pages(spark, sf_dir):
    return collection.files(spark, sf_dir).filter("extension <> 'pdf'").join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_id")), "file_id", "left_semi").select("relative_path")


@query(f"WITH {FILES_SQL} SELECT group_key, count(*) AS n FROM files WHERE group_key IN (SELECT DISTINCT group_key FROM files WHERE size > 12000) GROUP BY group_key")
def j8_groups_with_extracted(spark, sf_dir):
    files = collection.files(spark, sf_dir).select("group_key", "size")
    return files.join(files.filter("size > 12000").select("group_key").distinct(), "group_key", "left_semi").groupBy("group_key").agg(F.count("*").alias("n"))


@query(f"""WITH {FILES_SQL} SELECT f.relative_path FROM files f WHERE EXISTS (SELECT 1 FROM (VALUES ('SRC1/en'), ('src2'), ('src3/de')) s(folder) WHERE starts_with(lower(f.relative_path), lower(folder) || '/'))""")
def j10_under_skipped_folder(spark, sf_dir):
    """A path under a folder has that folder among its own prefixes, so the join is an equality."""
    skipped = spark.createDataFrame([("src1/en",), ("src2",), ("src3/de",)], "prefix string")
    parts = F.split(F.lower("relative_path"), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    paths = collection.files(spark, sf_dir).select("relative_path", F.explode(prefixes).alias("prefix"))
    return paths.join(F.broadcast(skipped), "prefix", "left_semi").select("relative_path").distinct()


@query(f"""WITH {ITEMS_SQL}, {SIZES_SQL} SELECT i.line, pos FROM (SELECT line, group_key, unnest(range(start_order, end_order + 1)) AS pos FROM items) i JOIN sizes s USING (group_key) WHERE pos BETWEEN 1 AND pages""")
def j12_pieces_to_pages(spark, sf_dir):
    spots = collection.items(spark, sf_dir).select("line", "group_key", F.explode(F.sequence("start_order", "end_order")).alias("pos"))
    return spots.join(collection.group_sizes(spark, sf_dir), "group_key").filter("pos between 1 and pages").select("line", "pos")


_MATCH_SQL = """one AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY line ORDER BY group_key, start_order, end_order) = 1),
k AS (SELECT line AS key_id, group_key, start_order AS a, end_order + 1 AS b FROM one WHERE line % 9 = 0), x AS (SELECT line AS index_id, group_key, start_order AS c, end_order AS d FROM one WHERE line % 9 = 1),
n AS (SELECT key_id, index_id, least(b, d) - greatest(a, c) + 1 AS n, b - a + 1 + d - c + 1 AS both_ FROM k JOIN x USING (group_key) WHERE least(b, d) >= greatest(a, c))"""


def _key_and_rest(spark, sf_dir):
    """One ninth of the pieces as key, all others as index."""
    items = collection.items(spark, sf_dir).groupBy("line").agg(F.min(F.struct("group_key", "start_order", "end_order")).alias("x")).select("line", "x.*")
    key = items.filter(F.col("line") % 9 == 0).select(F.col("line").alias("id"), "group_key", "start_order", (F.col("end_order") + 1).alias("end_order"))
    return key, items.filter(F.col("line") % 9 != 0).select(F.col("line").alias("id"), "group_key", "start_order", "end_order")


def _key_and_index(spark, sf_dir):
    """The part of them that the SQL of j14 compares."""
    key, rest = _key_and_rest(spark, sf_dir)
    return key, rest.filter(F.col("id") % 9 == 1)


@query(f"""WITH RECURSIVE {ITEMS_SQL}, {_MATCH_SQL} SELECT key_id, index_id, n / CAST(both_ - n AS DOUBLE) AS score FROM n""")
def j14_jaccard_pairs(spark, sf_dir):
    key, index = _key_and_index(spark, sf_dir)
    spot = lambda df, n: df.select(F.col("id").alias(n), "group_key", F.explode(F.sequence("start_order", "end_order")).alias("pos"), (F.col("end_order") - F.col("start_order") + 1).alias(f"{n}_n"))
    both = spot(key, "key_id").join(spot(index, "index_id"), ["group_key", "pos"]).groupBy("key_id", "index_id", "key_id_n", "index_id_n").agg(F.count("*").alias("n"))
    return both.select("key_id", "index_id", (F.col("n") / (F.col("key_id_n") + F.col("index_id_n") - F.col("n"))).alias("score"))


@query()
def j15_greedy_matching(spark, sf_dir):
    """One-to-one, best first; each round needs the last one's result, which plain SQL cannot say."""
    return pieces.matched(*_key_and_rest(spark, sf_dir))


@query(f"""WITH {PAGES_SQL}, p AS (SELECT file_id, number, CASE WHEN length(text) % 3 = 0 THEN role END AS script FROM pages_),
w AS (SELECT p.file_id, p.number, p.script, q.script AS near, row_number() OVER (PARTITION BY p.file_id, p.number ORDER BY abs(q.number - p.number), q.number) AS r FROM p LEFT JOIN p q ON p.file_id = q.file_id AND q.script IS NOT NULL)
SELECT file_id, number, coalesce(script, near) AS script FROM w WHERE r = 1""")
def j16_nearest_known(spark, sf_dir):
    rows = collection.pages(spark, sf_dir).select("file_id", "number", F.when(F.length("text") % 3 == 0, F.col("role")).alias("script"))
    by = Window.partitionBy("file_id").orderBy("number")
    known = F.when(F.col("script").isNotNull(), F.struct("number", "script"))
    low = F.last(known, True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first(known, True).over(by.rowsBetween(0, Window.unboundedFollowing))
    near = F.when(low.isNull() | (high["number"] - F.col("number") < F.col("number") - low["number"]), high["script"]).otherwise(low["script"])
    return rows.select("file_id", "number", near.alias("script"))


@query(f"""WITH {ITEMS_SQL}, n AS (SELECT *, lead(start_order) OVER w AS ns, lead(end_order) OVER w AS ne FROM items WINDOW w AS (PARTITION BY group_key ORDER BY start_order, end_order, line))
SELECT line, group_key, start_order, CASE WHEN start_order < ns AND ns <= end_order AND end_order < ne THEN ns - 1 ELSE end_order END AS end_order FROM n""")
def j17_trim_overlaps(spark, sf_dir):
    return pieces.trimmed(collection.items(spark, sf_dir)).select("line", "group_key", "start_order", "end_order")


@query(f"""WITH {FILES_SQL}, p AS (SELECT *, lag(name) OVER w AS before, lag(extension) OVER w AS was FROM files WINDOW w AS (PARTITION BY group_key ORDER BY file_id))
SELECT file_id, before IS NOT NULL AND before <> name AND (extension <> 'pdf' OR was <> 'pdf') AS new_document FROM p""")
def j18_document_change(spark, sf_dir):
    rows = ordered.previous(collection.files(spark, sf_dir).drop("text"), ["group_key"], ["file_id"], {"before": "name", "was": "extension"})
    whole = lambda c: ~F.col(c).isin(admission_paged())
    return rows.select("file_id", F.coalesce((F.col("before") != F.col("name")) & (whole("extension") | whole("was")), F.lit(False)).alias("new_document"))


def admission_paged() -> list[str]:
    from ..sources import admission

    return [e for c in admission.PAGED for e in admission.CATEGORIES[c]]


@query(f"""WITH {FILES_SQL}, own AS (SELECT file_id, group_key, CASE WHEN file_id % 3 = 0 THEN language END AS lang FROM files),
g AS (SELECT group_key, lang FROM own WHERE lang IS NOT NULL GROUP BY group_key, lang QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY count(*) DESC, lang) = 1),
a AS (SELECT lang FROM own WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1)
SELECT file_id, coalesce(own.lang, g.lang, (SELECT lang FROM a), 'por') AS language FROM own LEFT JOIN g USING (group_key)""")
def j19_fallback_language(spark, sf_dir):
    own = collection.files(spark, sf_dir).select("file_id", "group_key", F.when(F.col("file_id") % 3 == 0, F.col("language")).alias("lang"))
    counts = own.filter("lang is not null").groupBy("group_key", "lang").agg(F.count("*").alias("n"))
    of_group = counts.groupBy("group_key").agg(F.min_by("lang", F.struct(-F.col("n"), F.col("lang"))).alias("g"))
    top = counts.groupBy("lang").agg(F.sum("n").alias("n")).agg(F.min_by("lang", F.struct(-F.col("n"), F.col("lang")))).first()[0]
    return own.join(of_group, "group_key", "left").select("file_id", F.coalesce("lang", "g", F.lit(top), F.lit("por")).alias("language"))


@query(f"""WITH {ITEMS_SQL}, {SIZES_SQL}, {_SPANS_SQL} SELECT s.group_key, s.start_pos, u.pos FROM (SELECT group_key, start_pos, unnest(range(start_pos, end_pos + 1)) AS pos FROM spans) u JOIN spans s USING (group_key, start_pos)
WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.group_key = u.group_key AND u.pos BETWEEN i.start_order AND i.end_order)""")
def j20_uncovered_in_window(spark, sf_dir):
    spots = _spans(collection.group_sizes(spark, sf_dir)).select("group_key", "start_pos", F.explode(F.sequence("start_pos", "end_pos")).alias("pos"))
    taken = collection.items(spark, sf_dir).select("group_key", F.explode(F.sequence("start_order", "end_order")).alias("pos")).distinct()
    return spots.join(taken, ["group_key", "pos"], "left_anti").select("group_key", "start_pos", "pos")


@query("SELECT c_name AS name, 'shared' AS origin FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_name, 'local' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0")
def j22_catalog_union(spark, sf_dir):
    entries = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    shared, local = entries.filter("c_custkey % 3 <> 0"), entries.filter("c_custkey % 2 = 0")
    return shared.select("name", F.lit("shared").alias("origin")).unionByName(local.join(shared, "name", "left_anti").select("name", F.lit("local").alias("origin")))


# --- aggregates ------------------------------------------------------------------------------


@query(f"WITH {FILES_SQL} SELECT extension, count(*) AS n FROM files GROUP BY extension")
def a1_count_by_status(spark, sf_dir):
    return collection.files(spark, sf_dir).groupBy("extension").agg(F.count("*").alias("n"))


@query(f"WITH {ITEMS_SQL} SELECT confidence, count(*) AS n, count(*) FILTER (coalesce(trim(type), '') = '') AS no_type, count(*) FILTER (coalesce(trim(date), '') = '') AS no_date FROM items GROUP BY confidence")
def a2_confidence_and_blanks(spark, sf_dir):
    blank = lambda c: F.count_if(F.coalesce(F.trim(c), F.lit("")) == "")
    return collection.items(spark, sf_dir).groupBy("confidence").agg(F.count("*").alias("n"), blank("type").alias("no_type"), blank("date").alias("no_date"))


@query(f"""WITH {ITEMS_SQL}, {SIZES_SQL}, m AS (SELECT count(*) AS n, avg(CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.6 ELSE 0.2 END) AS conf,
    count(type) AS typed, count(date) AS dated FROM items), s AS (SELECT i.group_key, unnest(range(greatest(start_order, 1), least(end_order, pages) + 1)) AS pos FROM items i JOIN sizes USING (group_key)),
c AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT group_key, pos FROM s)) / CAST((SELECT sum(pages) FROM sizes) AS DOUBLE) AS coverage)
SELECT n, coverage, conf, CASE WHEN dated / CAST(n AS DOUBLE) >= 0.05 THEN (typed + dated) / (2.0 * n) ELSE typed / CAST(n AS DOUBLE) END AS fill,
    CAST(round_even(100 * least(1, greatest(0, 0.40 * coverage + 0.35 * conf + 0.25 * fill)), 0) AS BIGINT) AS score FROM m, c""")
def a6_quality_score(spark, sf_dir):
    items, sizes = collection.items(spark, sf_dir), collection.group_sizes(spark, sf_dir)
    cover = pieces.covered_pages(items, sizes).agg((F.sum("covered") / F.sum("pages")).alias("coverage")).first()["coverage"]
    level = F.when(F.col("confidence") == "high", 1.0).when(F.col("confidence") == "medium", 0.6).otherwise(0.2)
    m = items.agg(F.count("*").alias("n"), F.avg(level).alias("conf"), F.count("type").alias("typed"), F.count("date").alias("dated")).withColumn("coverage", F.lit(cover))
    fill = F.when(F.col("dated") / F.col("n") >= 0.05, (F.col("typed") + F.col("dated")) / (2.0 * F.col("n"))).otherwise(F.col("typed") / F.col("n"))
    raw = 0.40 * F.col("coverage") + 0.35 * F.col("conf") + 0.25 * F.col("fill")
    return m.withColumn("fill", fill).select("n", "coverage", "conf", "fill", F.bround(100 * F.least(F.lit(1), F.greatest(F.lit(0), raw))).cast("long").alias("score"))


@query(f"WITH {PAGES_SQL} SELECT group_key, count(*) AS pages, count(DISTINCT file_id) AS files FROM pages_ GROUP BY group_key")
def a7_pages_per_group(spark, sf_dir):
    per_file = collection.pages(spark, sf_dir).groupBy("group_key", "file_id").agg(F.count("*").alias("n"))
    return per_file.groupBy("group_key").agg(F.sum("n").alias("pages"), F.count("*").alias("files"))


@query(f"WITH {FILES_SQL}, p AS (SELECT extension, CAST(size // 2000 + 1 AS BIGINT) AS pages FROM files) SELECT extension, CAST(sum(pages) AS BIGINT) AS pages, sum(CASE WHEN pages > 1 THEN pages ELSE 0 END) / CAST(sum(pages) AS DOUBLE) AS multi_share FROM p GROUP BY extension")
def a8_pages_per_extension(spark, sf_dir):
    pages = collection.files(spark, sf_dir).select("extension", (F.floor(F.col("size") / 2000) + 1).alias("pages"))
    return pages.groupBy("extension").agg(F.sum("pages").alias("pages"), (F.sum(F.when(F.col("pages") > 1, F.col("pages")).otherwise(0)) / F.sum("pages")).alias("multi_share"))


@query(f"WITH {ITEMS_SQL} SELECT count(DISTINCT group_key) AS groups, coalesce(sum(end_order - start_order + 1), 0)::BIGINT AS pages FROM items")
def a9_distinct_groups(spark, sf_dir):
    by_group = collection.items(spark, sf_dir).groupBy("group_key").agg(F.sum(F.col("end_order") - F.col("start_order") + 1).alias("n"))
    return by_group.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("pages"))


@query(f"WITH {PAGES_SQL}, f AS (SELECT file_id, role, min(number) AS first FROM pages_ GROUP BY ALL) SELECT file_id, string_agg(role, ', ' ORDER BY first) AS roles FROM f GROUP BY file_id")
def a11_ordered_distinct(spark, sf_dir):
    first = collection.pages(spark, sf_dir).groupBy("file_id", "role").agg(F.min("number").alias("first"))
    return first.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "role"))), lambda x: x["role"]), ", ").alias("roles"))


@query(f"WITH {PAGES_SQL} SELECT file_id, bool_or(contains(text, '?')) AS has_question, arg_min(role, number) FILTER (role <> 'system') AS first_speaker FROM pages_ GROUP BY file_id")
def a12_flags_and_first(spark, sf_dir):
    spoken = F.col("role") != "system"
    return collection.pages(spark, sf_dir).groupBy("file_id").agg(F.bool_or(F.col("text").contains("?")).alias("has_question"), F.min_by(F.when(spoken, F.col("role")), F.when(spoken, F.col("number"))).alias("first_speaker"))


@query("""SELECT source, lang FROM (SELECT source, lang, sum(length(regexp_replace(text, '[^A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g'))) AS w FROM documents GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY w DESC, lang) = 1""")
def a14_majority_language(spark, sf_dir):
    letters = F.length(F.regexp_replace("text", "[^A-Za-zÀ-ÖØ-öø-ÿ]", ""))
    weights = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.sum(letters).alias("w"))
    return weights.groupBy("source").agg(F.min_by("lang", F.struct(-F.col("w"), F.col("lang"))).alias("lang"))


@query(f"WITH {FILES_SQL}, c AS (SELECT group_key, language, count(*) AS n, min(file_id) AS f FROM files GROUP BY ALL) SELECT group_key, language FROM c QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY n DESC, f) = 1")
def a15_plain_majority(spark, sf_dir):
    counts = collection.files(spark, sf_dir).groupBy("group_key", "language").agg(F.count("*").alias("n"), F.min("file_id").alias("f"))
    return counts.groupBy("group_key").agg(F.min_by("language", F.struct(-F.col("n"), F.col("f"))).alias("language"))


_SPELL_SQL = """v AS (SELECT CASE WHEN l_linenumber % 2 = 0 AND l_partkey % 5 < 2 THEN 'ÍNDICE ' WHEN l_partkey % 5 < 4 THEN 'INDICE ' ELSE 'Indice ' END || (l_suppkey % 9) AS name FROM lineitem),
c AS (SELECT name, strip_accents(upper(name)) AS key, upper(name) <> strip_accents(upper(name)) AS accented, count(*) AS n FROM v GROUP BY ALL)"""


@query(f"""WITH {_SPELL_SQL}, b AS (SELECT key, arg_max(name, (n, name)) AS best, max(n) AS bn, arg_max(name, (n, name)) FILTER (accented) AS runner, max(n) FILTER (accented) AS rn, arg_max(accented, (n, name)) AS ba FROM c GROUP BY key)
SELECT key, CASE WHEN NOT ba AND runner IS NOT NULL AND rn * 2 >= bn THEN runner ELSE best END AS spelling FROM b""")
def a16_canonical_spelling(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    name = F.when((F.col("l_linenumber") % 2 == 0) & (F.col("l_partkey") % 5 < 2), "ÍNDICE ").when(F.col("l_partkey") % 5 < 4, "INDICE ").otherwise("Indice ")
    named = li.select(F.concat(name, (F.col("l_suppkey") % 9).cast("string")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    key = t.fold(F.upper("name"))
    c = named.withColumns({"key": key, "accented": F.upper("name") != key})
    rank = F.struct("n", "name")
    b = c.groupBy("key").agg(
        F.max_by("name", rank).alias("best"), F.max("n").alias("bn"), F.max_by("accented", rank).alias("ba"),
        F.max(F.when(F.col("accented"), rank)).alias("runner"),
    )
    wins = ~F.col("ba") & F.col("runner").isNotNull() & (F.col("runner.n") * 2 >= F.col("bn"))
    return b.select("key", F.when(wins, F.col("runner.name")).otherwise(F.col("best")).alias("spelling"))


@query(f"""WITH RECURSIVE {FILES_SQL}, b AS (SELECT group_key, size, row_number() OVER (PARTITION BY group_key ORDER BY file_id) AS rn FROM files), f AS (
    SELECT group_key, rn, size AS held, 1 AS part FROM b WHERE rn = 1 UNION ALL
    SELECT b.group_key, b.rn, CASE WHEN f.held + b.size > 25000 THEN b.size ELSE f.held + b.size END, f.part + CASE WHEN f.held + b.size > 25000 THEN 1 ELSE 0 END FROM f JOIN b ON b.group_key = f.group_key AND b.rn = f.rn + 1)
SELECT group_key, CAST(part AS BIGINT) AS part, count(*) AS blocks, CAST(max(held) AS BIGINT) AS bytes FROM f GROUP BY group_key, part""")
def a17_sequential_parts(spark, sf_dir):
    """Contiguous blocks under a budget: a fold over (id, size) pairs of a group, which never holds texts."""
    blocks = collection.files(spark, sf_dir).groupBy("group_key").agg(F.array_sort(F.collect_list(F.struct("file_id", F.col("size").cast("long").alias("size")))).alias("m"))
    fold = """aggregate(m, cast(array() as array<struct<blocks:bigint,bytes:bigint>>), (acc, x) -> if(size(acc) > 0 and element_at(acc, -1).bytes + x.size <= 25000,
        concat(slice(acc, 1, size(acc) - 1), array(named_struct('blocks', element_at(acc, -1).blocks + 1, 'bytes', element_at(acc, -1).bytes + x.size))), concat(acc, array(named_struct('blocks', 1L, 'bytes', x.size)))))"""
    return blocks.select("group_key", F.posexplode(F.expr(fold)).alias("p", "b")).select("group_key", (F.col("p") + 1).cast("long").alias("part"), "b.blocks", "b.bytes")


@query(f"""WITH {FILES_SQL}, k AS (SELECT group_key, CAST(floor(size / 3.0) AS BIGINT) AS tokens, size > 15000 AS excluded FROM files)
SELECT group_key, CAST(coalesce(sum(tokens) FILTER (NOT excluded), 0) AS BIGINT) AS tokens, count(*) FILTER (excluded) AS excluded, CASE WHEN coalesce(sum(tokens) FILTER (NOT excluded), 0) > 60000 THEN 'over' WHEN coalesce(sum(tokens) FILTER (NOT excluded), 0) > 30000 THEN 'rag' ELSE 'ok' END AS level FROM k GROUP BY group_key""")
def a18_token_budget(spark, sf_dir):
    k = collection.files(spark, sf_dir).select("group_key", F.floor(F.col("size") / 3.0).alias("tokens"), (F.col("size") > 15000).alias("excluded"))
    g = k.groupBy("group_key").agg(F.coalesce(F.sum(F.when(~F.col("excluded"), F.col("tokens"))), F.lit(0)).alias("tokens"), F.count_if("excluded").alias("excluded"))
    return g.withColumn("level", F.when(F.col("tokens") > 60000, "over").when(F.col("tokens") > 30000, "rag").otherwise("ok"))


@query("""WITH r AS (SELECT event_type AS engine, user_id % 3 AS model, value AS seconds, event_id % 7 AS items, CASE WHEN user_id % 5 = 0 THEN 'auto' ELSE '8' END AS par FROM events)
SELECT engine, model, round(sum(seconds), 4) AS seconds, CAST(sum(items) AS BIGINT) AS items, round(60 * sum(items) / sum(seconds), 4) AS per_minute, list_sort(list(DISTINCT par)) AS parallelism, count(DISTINCT par) > 1 AS mixed FROM r GROUP BY engine, model""")
def a19_run_comparison(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    r = e.select(F.col("event_type").alias("engine"), (F.col("user_id") % 3).alias("model"), F.col("value").alias("seconds"), (F.col("event_id") % 7).alias("items"), F.when(F.col("user_id") % 5 == 0, "auto").otherwise("8").alias("par"))
    par = F.array_sort(F.collect_set("par"))
    return r.groupBy("engine", "model").agg(
        F.round(F.sum("seconds"), 4).alias("seconds"), F.sum("items").alias("items"), F.round(60 * F.sum("items") / F.sum("seconds"), 4).alias("per_minute"), par.alias("parallelism"), (F.size(par) > 1).alias("mixed"),
    )


@query(f"""WITH {FILES_SQL}, s AS (SELECT group_key, size, row_number() OVER (PARTITION BY group_key ORDER BY size) AS r, count(*) OVER (PARTITION BY group_key) AS n FROM files)
SELECT group_key, CAST(least(4000, greatest(1500, ceil(size / 500.0) * 500)) AS BIGINT) AS chars FROM s WHERE r = CAST(floor(0.75 * (n - 1)) AS BIGINT) + 1""")
def a21_p75_page_length(spark, sf_dir):
    """The element at floor(0.75 (n - 1)) of the sorted sizes, found by counts of each size instead of a list of all."""
    counts = collection.files(spark, sf_dir).groupBy("group_key", "size").agg(F.count("*").alias("n"))
    run = ordered.running_sum(counts, ["group_key"], ["size"], "n", "upto")
    total = counts.groupBy("group_key").agg(F.sum("n").alias("total"))
    at = run.join(total, "group_key").filter(F.col("upto") > F.floor(0.75 * (F.col("total") - 1)))
    return at.groupBy("group_key").agg(F.min("size").alias("size")).select("group_key", F.least(F.lit(4000), F.greatest(F.lit(1500), F.ceil(F.col("size") / 500.0) * 500)).cast("long").alias("chars"))


@query(f"""WITH {ITEMS_SQL} SELECT group_key, confidence, grouping(group_key) AS g1, grouping(confidence) AS g2, count(*) AS pieces, count(type) / CAST(count(*) AS DOUBLE) AS typed, count(date) / CAST(count(*) AS DOUBLE) AS dated FROM items
GROUP BY GROUPING SETS ((), (group_key), (confidence))""")
def a22_grouped_accuracy(spark, sf_dir):
    collection.items(spark, sf_dir).createOrReplaceTempView("dossierflow_items")
    return spark.sql("""SELECT group_key, confidence, cast(grouping(group_key) as bigint) AS g1, cast(grouping(confidence) as bigint) AS g2, count(*) AS pieces, count(type) / count(*) AS typed, count(date) / count(*) AS dated
        FROM dossierflow_items GROUP BY GROUPING SETS ((), (group_key), (confidence))""")


@query(f"WITH {FILES_SQL} SELECT group_key, CAST(sum(CAST(CAST('0x' || substr(md5(relative_path || ':' || size || ':' || sha256), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS fingerprint, count(*) AS files FROM files GROUP BY group_key")
def a25_listing_fingerprint(spark, sf_dir):
    """A sum of hashes of the lines: it does not depend on their order, and parts of a group add up, so no group is gathered."""
    line = F.concat_ws(":", "relative_path", "size", "sha256")
    number = F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("decimal(20,0)")
    return collection.files(spark, sf_dir).groupBy("group_key").agg(F.sum(number).cast("decimal(38,0)").cast("string").alias("fingerprint"), F.count("*").alias("files"))


@query(f"WITH {ITEMS_SQL} SELECT max(line) AS last_line, count(*) AS pieces, max(end_order) AS last_page, count(DISTINCT group_key) AS groups FROM items")
def a26_change_signature(spark, sf_dir):
    by = collection.items(spark, sf_dir).groupBy("group_key").agg(F.max("line").alias("l"), F.count("*").alias("n"), F.max("end_order").alias("e"))
    return by.agg(F.max("l").alias("last_line"), F.sum("n").alias("pieces"), F.max("e").alias("last_page"), F.count("*").alias("groups"))

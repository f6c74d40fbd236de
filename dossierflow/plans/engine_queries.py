"""Queries on engines and the rest of the survey's sets, joins and aggregates (X, W, U, J, A, S, R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import ordered, pieces, rules, upkeep
from ..sources import collection
from ..sources.collection import FILES_SQL, ITEMS_SQL, PAGES_SQL, SIZES_SQL, table
from .piece_queries import _SPANS_SQL, _spans
from .registry import query
from .text_queries import _place


def _window_pages(spark, sf_dir):
    rows = ordered.positions(collection.pages(spark, sf_dir).withColumn("key", t.natural_key(F.col("path"))), ["group_key"], ["key", "number"])
    spans = _spans(rows.groupBy("group_key").agg(F.count("*").alias("pages")))
    spots = spans.select("group_key", "start_pos", F.explode(F.sequence("start_pos", "end_pos")).alias("pos"))
    return spots.join(rows, ["group_key", "pos"]).select("group_key", "start_pos", "pos", F.col("path").alias("file"), F.lit(False).alias("whole"), "text", "role")


_RULES = rules.Rules(types={"THE": ["THE "], "DER": ["DER "], "QUE": [" QUE "]}, headings=[], protocol=["scum", "worthless"], summary_markers=["Subject:"], author_markers=["Signed by"])


@query(f"""WITH RECURSIVE {PAGES_SQL}, sizes AS (SELECT group_key, count(*) AS pages FROM pages_ GROUP BY group_key), {_SPANS_SQL},
p AS (SELECT group_key, path, text, row_number() OVER (PARTITION BY group_key ORDER BY file_id, number) AS pos FROM pages_),
w AS (SELECT s.group_key, s.start_pos, p.pos, p.path AS file, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '') AS first_line, upper(substr(text, 1, 200)) AS h,
    regexp_matches(text, '(?i)scum|worthless') AS protocol, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < 10 AS blank FROM spans s JOIN p ON s.group_key = p.group_key AND p.pos BETWEEN s.start_pos AND s.end_pos),
y AS (SELECT *, coalesce({_place('THE ')}, 999) AS a1, coalesce({_place('DER ')}, 999) AS a2, coalesce({_place(' QUE ')}, 999) AS a3 FROM w),
x AS (SELECT *, CASE WHEN least(a1, a2, a3) = 999 THEN NULL WHEN a1 <= least(a2, a3) THEN 'THE' WHEN a2 <= a3 THEN 'DER' ELSE 'QUE' END AS type FROM y),
f AS (
    SELECT group_key, start_pos, pos, 1 AS item, type, NOT (type IS NOT NULL OR protocol) AS low, CASE WHEN first_line <> '' THEN first_line END AS header, CASE WHEN first_line <> '' THEN 1 ELSE 0 END AS seen, blank FROM x WHERE pos = start_pos
    UNION ALL
    SELECT x.group_key, x.start_pos, x.pos, f.item + CASE WHEN signal AND NOT x.blank THEN 1 ELSE 0 END, x.type, NOT signal, CASE WHEN x.first_line <> '' THEN x.first_line ELSE f.header END,
        CASE WHEN x.first_line = '' THEN f.seen WHEN f.header = x.first_line THEN f.seen + 1 ELSE 1 END, x.blank
    FROM f JOIN x ON x.group_key = f.group_key AND x.start_pos = f.start_pos AND x.pos = f.pos + 1,
        LATERAL (SELECT x.type IS NOT NULL OR x.protocol OR f.blank OR (x.first_line <> '' AND f.header IS NOT NULL AND f.seen >= 2 AND x.first_line <> f.header) AS signal))
SELECT group_key, start_pos, min(pos) AS start_order, max(pos) AS end_order, arg_min(type, pos) FILTER (type IS NOT NULL) AS type, CASE WHEN bool_or(low) THEN 'low' WHEN count(type) > 0 THEN 'high' ELSE 'medium' END AS confidence, count(*) AS pages
FROM f GROUP BY group_key, start_pos, item""")
def x7_rules_engine(spark, sf_dir):
    out = rules.classify(_window_pages(spark, sf_dir), ["group_key", "start_pos"], _RULES)
    return out.select("group_key", "start_pos", "start_order", "end_order", "type", "confidence", "pages")


@query()
def w13_rows_to_pieces(spark, sf_dir):
    """A model's rows grouped to pieces; checked against a loop in the tests."""
    rows = _window_pages(spark, sf_dir).select(
        "group_key", "start_pos", "pos", "file", F.substring("text", 1, 12).alias("subject"), F.col("role").alias("type"), F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("author"),
        F.substring("text", 1, 60).alias("detail"), (F.length("text") % 2 == 0).alias("continues"),
    )
    return rules.rows_to_items(rows, ["group_key", "start_pos"])


@query(f"""WITH {SIZES_SQL}, {_SPANS_SQL} SELECT group_key, start_pos, end_pos FROM spans WHERE start_pos <= 105 AND end_pos >= 98 OR start_pos <= 201 AND end_pos >= 201""")
def w16_in_place_windows(spark, sf_dir):
    """Windows that hold a changed page: changed offsets become window starts, so the join is an equality."""
    spans = _spans(collection.group_sizes(spark, sf_dir))
    changed = spark.createDataFrame([(k,) for k in [*range(98, 106), 201]], "pos long")
    return spans.select("*", F.explode(F.sequence("start_pos", "end_pos")).alias("pos")).join(F.broadcast(changed), "pos", "left_semi").select("group_key", "start_pos", "end_pos").distinct()


@query(f"""WITH {PAGES_SQL}, c AS (SELECT group_key, file_id, count(*) AS n FROM pages_ GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY group_key ORDER BY file_id) - n AS before FROM c)
SELECT group_key, file_id, CAST(before AS BIGINT) AS before FROM r WHERE before >= 10 AND file_id % 4 <> 0""")
def w17_files_to_renumber(spark, sf_dir):
    counts = collection.pages(spark, sf_dir).groupBy("group_key", "file_id").agg(F.count("*").alias("n"))
    return ordered.running_sum(counts, ["group_key"], ["file_id"], "n", "before", exclusive=True).filter("before >= 10 and file_id % 4 <> 0").select("group_key", "file_id", F.col("before").cast("long").alias("before"))


@query("""WITH w AS (SELECT item_id, len(regexp_extract_all(text, '\\bthe\\b')) AS n FROM benchmark WHERE contains(text, 'the')), g AS (SELECT item_id, 1 AS n FROM benchmark WHERE contains(text, 'and'))
SELECT item_id, min(n) AS score FROM (SELECT * FROM w UNION ALL SELECT * FROM g) GROUP BY item_id""")
def u1_union_of_hits(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark")
    words = rows.filter(F.col("text").contains("the")).select("item_id", F.regexp_count("text", F.lit(r"\bthe\b")).cast("long").alias("n"))
    grams = rows.filter(F.col("text").contains("and")).select("item_id", F.lit(1).cast("long").alias("n"))
    return words.unionByName(grams).groupBy("item_id").agg(F.min("n").alias("score"))


@query(f"WITH {ITEMS_SQL} SELECT DISTINCT group_key FROM items")
def u7_distinct_groups(spark, sf_dir):
    return collection.items(spark, sf_dir).select("group_key").distinct()


@query(f"WITH {ITEMS_SQL} SELECT line, CASE WHEN group_key IN (SELECT group_key FROM items GROUP BY group_key HAVING bool_and(confidence = 'low' OR line % 2 = 0)) THEN 'pending' ELSE 'done' END AS status FROM items")
def u8_requeue_windows(spark, sf_dir):
    rows = collection.items(spark, sf_dir)
    only = rows.groupBy("group_key").agg(F.bool_and((F.col("confidence") == "low") | (F.col("line") % 2 == 0)).alias("p"))
    return rows.join(only, "group_key").select("line", F.when(F.col("p"), "pending").otherwise("done").alias("status"))


@query(f"""WITH {ITEMS_SQL}, o AS (SELECT line, group_key, type, lead(line) OVER (PARTITION BY group_key ORDER BY start_order, end_order, line) AS nl, start_order, end_order, lead(start_order) OVER (PARTITION BY group_key ORDER BY start_order, end_order, line) AS ns, lead(end_order) OVER (PARTITION BY group_key ORDER BY start_order, end_order, line) AS ne FROM items)
SELECT line, greatest(0, least(end_order, ne) - greatest(start_order, ns) + 1) / CAST(greatest(end_order, ne) - least(start_order, ns) + 1 AS DOUBLE) AS jaccard FROM o WHERE nl IS NOT NULL AND ns <= end_order""")
def u4_jaccard_of_neighbours(spark, sf_dir):
    rows = collection.items(spark, sf_dir).withColumns({"s": -F.col("start_order"), "e": -F.col("end_order"), "l": -F.col("line")})
    n = ordered.previous(rows, ["group_key"], ["s", "e", "l"], {"ns": "start_order", "ne": "end_order"}).filter("ns <= end_order")
    spots = lambda a, b: F.sequence(a, b)
    mine, other = spots(F.col("start_order"), F.col("end_order")), spots(F.col("ns"), F.col("ne"))
    return n.select("line", (F.size(F.array_intersect(mine, other)) / F.size(F.array_union(mine, other))).alias("jaccard"))


@query(f"""WITH {FILES_SQL}, s AS (SELECT file_id, CASE WHEN file_id % 4 = 0 THEN 'doc' || (file_id // 4) || '.pdf.p7s' ELSE 'doc' || (file_id // 4) || '.' || ['pdf','docx','txt'][file_id % 4] END AS name FROM files),
g AS (SELECT file_id, name, regexp_replace(name, '\\.p7s$', '') AS stem, regexp_replace(regexp_replace(name, '\\.p7s$', ''), '\\.[^.]*$', '') AS base FROM s)
SELECT a.file_id, coalesce(min(b.file_id) FILTER (b.name = a.stem), CASE WHEN count(b.file_id) = 1 THEN min(b.file_id) END) AS sibling FROM g a LEFT JOIN g b ON a.base = b.base AND NOT ends_with(b.name, '.p7s') WHERE ends_with(a.name, '.p7s') GROUP BY a.file_id""")
def j23_detached_sibling(spark, sf_dir):
    k = F.col("file_id")
    name = F.when(k % 4 == 0, F.concat(F.lit("doc"), F.floor(k / 4), F.lit(".pdf.p7s"))).otherwise(F.concat(F.lit("doc"), F.floor(k / 4), F.lit("."), F.get(F.array(F.lit(""), F.lit("pdf"), F.lit("docx"), F.lit("txt")), (k % 4).cast("int"))))
    files = collection.files(spark, sf_dir).select("file_id", name.alias("name")).withColumn("stem", F.regexp_replace("name", r"\.p7s$", ""))
    files = files.withColumn("base", F.regexp_replace("stem", r"\.[^.]*$", ""))
    signed, plain = files.filter(F.col("name").endswith(".p7s")), files.filter(~F.col("name").endswith(".p7s")).select("base", F.col("file_id").alias("other"), F.col("name").alias("other_name"))
    both = signed.join(plain, "base", "left").groupBy("file_id").agg(F.min(F.when(F.col("other_name") == F.col("stem"), F.col("other"))).alias("exact"), F.count("other").alias("n"), F.min("other").alias("any"))
    return both.select("file_id", F.coalesce("exact", F.when(F.col("n") == 1, F.col("any"))).alias("sibling"))


@query("""SELECT source, count(*) AS files, round_even(avg(n_chars), 0)::BIGINT * count(*) AS estimated FROM documents GROUP BY source""")
def a29_survey_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), (F.bround(F.avg("n_chars")).cast("long") * F.count("*")).alias("estimated"))


@query("""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), s AS (SELECT lang, n / CAST(sum(n) OVER () AS DOUBLE) AS share FROM c) SELECT lang, share FROM s WHERE share >= 0.05 ORDER BY share DESC, lang LIMIT 2""")
def a33_project_languages(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    return counts.select("lang", (F.col("n") / total).alias("share")).filter("share >= 0.05").orderBy(F.desc("share"), "lang").limit(2)


@query(f"""WITH {ITEMS_SQL}, k AS (SELECT group_key, start_order, type, date FROM items WHERE line % 9 = 0), m AS (SELECT i.confidence, i.type AS t1, k.type AS t2, i.date AS d1, k.date AS d2 FROM items i JOIN k USING (group_key, start_order) WHERE line % 9 = 1)
SELECT confidence, count(*) AS matched, count(*) FILTER (coalesce(t1, '') = coalesce(t2, '')) AS type_hits, count(d2) AS dated, count(*) FILTER (d1 = d2) AS date_hits FROM m GROUP BY confidence""")
def a30_accuracy_by_confidence(spark, sf_dir):
    items = collection.items(spark, sf_dir)
    key = items.filter(F.col("line") % 9 == 0).select("group_key", "start_order", F.col("type").alias("t2"), F.col("date").alias("d2"))
    m = items.filter(F.col("line") % 9 == 1).join(key, ["group_key", "start_order"])
    blank = lambda c: F.coalesce(c, F.lit(""))
    return m.groupBy("confidence").agg(F.count("*").alias("matched"), F.count_if(blank("type") == blank("t2")).alias("type_hits"), F.count("d2").alias("dated"), F.count_if(F.col("date") == F.col("d2")).alias("date_hits"))


@query(f"WITH {ITEMS_SQL} SELECT engine, confidence, count(*) AS written FROM items GROUP BY ALL")
def a34_written_by_confidence(spark, sf_dir):
    return collection.items(spark, sf_dir).groupBy("engine", "confidence").agg(F.count("*").alias("written"))


@query(f"""WITH {FILES_SQL}, a AS (SELECT group_key, min(string_split(relative_path, '/')) AS lo, max(string_split(relative_path, '/')) AS hi FROM files GROUP BY group_key)
SELECT group_key, array_to_string(lo[1:coalesce(list_position(list_transform(range(1, 4), lambda i: lo[i] = hi[i] AND i < len(lo)), false) - 1, 3)], '/') AS root FROM a""")
def a24_common_folder(spark, sf_dir):
    """The common prefix of all paths of a group is that of the smallest and the largest one, so two aggregates do."""
    parts = F.split("relative_path", "/")
    ends = collection.files(spark, sf_dir).groupBy("group_key").agg(F.min(parts).alias("lo"), F.max(parts).alias("hi"))
    differs = F.get(F.filter(F.sequence(F.lit(1), F.lit(3)), lambda i: ~F.coalesce((F.get("lo", i - 1) == F.get("hi", i - 1)) & (i < F.size("lo")), F.lit(False))), F.lit(0))
    return ends.select("group_key", F.array_join(F.slice("lo", F.lit(1), F.coalesce(differs - 1, F.lit(3))), "/").alias("root"))


@query(f"""WITH {ITEMS_SQL}, d AS (SELECT DISTINCT group_key, end_order AS pos FROM items) SELECT i.group_key, i.start_order, count(d.pos) AS ends_inside FROM (SELECT DISTINCT group_key, start_order FROM items WHERE line % 50 = 0) i LEFT JOIN d ON d.group_key = i.group_key AND d.pos BETWEEN i.start_order AND i.start_order + 9 GROUP BY ALL""")
def j11_interval_containment(spark, sf_dir):
    items = collection.items(spark, sf_dir)
    spans = items.filter(F.col("line") % 50 == 0).select("group_key", "start_order").distinct()
    spots = spans.select("group_key", "start_order", F.explode(F.sequence("start_order", F.col("start_order") + 9)).alias("pos"))
    ends = items.select("group_key", F.col("end_order").alias("pos")).distinct().withColumn("hit", F.lit(1))
    return spots.join(ends, ["group_key", "pos"], "left").groupBy("group_key", "start_order").agg(F.count("hit").alias("ends_inside"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def j25_whole_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("body"))


@query("SELECT conv_id, turn, text AS message, CASE role WHEN 'user' THEN 'Asked' WHEN 'assistant' THEN 'Answered' END AS label FROM conversations")
def j21_message_dictionary(spark, sf_dir):
    words = spark.createDataFrame([("user", "Asked"), ("assistant", "Answered")], "role string, label string")
    return table(spark, sf_dir, "conversations").join(F.broadcast(words), "role", "left").select("conv_id", "turn", F.col("text").alias("message"), "label")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type || '.' || coalesce(json_extract_string(props, '$.k'), '?') AS line FROM events")
def f44_rendered_events(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.concat_ws(".", "event_type", F.coalesce(k.cast("string"), F.lit("?"))).alias("line"))


@query(f"""WITH {FILES_SQL} SELECT file_id, extension IN ('docx', 'md', 'html', 'txt', 'eml', 'xyz', 'zip', 'mp3', 'pem', 'gdoc', 'exe') AS whole_document FROM files""")
def p9_whole_document(spark, sf_dir):
    from ..sources import admission

    return collection.files(spark, sf_dir).select("file_id", (~F.coalesce(admission.category(F.col("extension")).isin(admission.PAGED), F.lit(False))).alias("whole_document"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE text END AS text FROM documents")
def p3_readable_text(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("\x00"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", t.readable(raw).alias("text"))


@query(f"""WITH {FILES_SQL}, {"n AS (SELECT file_id, relative_path, size, row_number() OVER (PARTITION BY relative_path ORDER BY file_id DESC) AS r FROM files)"} SELECT relative_path, size FROM n WHERE r = 1""")
def s26_register_latest(spark, sf_dir):
    return upkeep.latest(collection.files(spark, sf_dir).select("relative_path", "file_id", "size"), ["relative_path"], ["file_id"]).select("relative_path", "size")


@query("SELECT conv_id, turn, CASE WHEN length(text) > 300 THEN text ELSE coalesce(longer, text) END AS text FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt, CASE WHEN length(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)) > length(text) THEN lead(text) OVER (PARTITION BY conv_id ORDER BY turn) END AS longer FROM conversations)")
def r37_keep_longer_pages(spark, sf_dir):
    old = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    again = old.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("again"))
    longer = (F.length("text") <= 300) & (F.length("again") > F.length("text"))
    return old.join(again, ["conv_id", "turn"], "left").select("conv_id", "turn", F.when(longer, F.col("again")).otherwise(F.col("text")).alias("text"))

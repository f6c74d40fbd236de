"""Queries on the smaller operators of the survey: predicates, counts, text details and upkeep steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import ordered, search, upkeep
from ..sources import admission, collection
from ..sources.collection import FILES_SQL, ITEMS_SQL, PAGES_SQL, SIZES_SQL, table
from .registry import query


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(f"WITH {FILES_SQL} SELECT relative_path FROM files WHERE regexp_replace(relative_path, '/[^/]*$', '') NOT IN (SELECT regexp_replace(relative_path, '/[^/]*$', '') FROM files WHERE file_id % 97 = 0) ORDER BY lower(relative_path)")
def s2_without_generated_folders(spark, sf_dir):
    files = collection.files(spark, sf_dir).select("file_id", "relative_path", F.regexp_replace("relative_path", "/[^/]*$", "").alias("folder"))
    marked = files.filter(F.col("file_id") % 97 == 0).select("folder").distinct()
    return files.join(marked, "folder", "left_anti").select("relative_path").orderBy(F.lower("relative_path"))


@query("SELECT doc_id, md5(substr(hex(encode(text)), 1, 16384)) AS head FROM documents")
def s4_head_bytes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(F.hex(F.substring(F.col("text").cast("binary"), 1, admission.HEAD_BYTES))).alias("head"))


@query(f"WITH {FILES_SQL} SELECT file_id, extension IN ('pdf', 'txt', 'md') AS allowed, extension NOT IN ('exe', 'mp3') AS allowed_by_all FROM files")
def s10_extension_allowed(spark, sf_dir):
    ext = F.col("extension")
    every = ~ext.isin(admission.BLOCKED) & ~ext.isin(admission.CATEGORIES["media"])
    return collection.files(spark, sf_dir).select("file_id", F.coalesce(admission.category(ext).isin("pdf", "text"), F.lit(False)).alias("allowed"), every.alias("allowed_by_all"))


@query("""WITH l AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '{oops' WHEN 1 THEN '' ELSE props END AS line FROM events) SELECT event_id, json_valid(line) AS sound, CASE WHEN json_valid(line) THEN CAST(json_extract_string(line, '$.k') AS BIGINT) END AS k FROM l""")
def s18_json_lines(spark, sf_dir):
    line = F.when(F.col("event_id") % 7 == 0, "{oops").when(F.col("event_id") % 7 == 1, "").otherwise(F.col("props"))
    parsed = F.from_json(line, "k bigint, _corrupt_record string", {"mode": "PERMISSIVE"})
    return table(spark, sf_dir, "events").select("event_id", (parsed.isNotNull() & parsed["_corrupt_record"].isNull() & (line != "")).alias("sound"), parsed["k"].alias("k"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND EXISTS (SELECT 1 FROM conversations WHERE conv_id = doc_id)")
def s24_holds_old_data(spark, sf_dir):
    return _docs(spark, sf_dir).filter("doc_id % 3 = 0").join(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id")


@query("SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0)")
def s25_drop_derived(spark, sf_dir):
    gone = _docs(spark, sf_dir).filter("doc_id % 3 = 0").select(F.col("doc_id").alias("conv_id"))
    return upkeep.without(table(spark, sf_dir, "conversations"), gone, ["conv_id"]).select("conv_id", "turn")


@query(f"WITH {FILES_SQL} SELECT file_id, CASE WHEN extension = 'pdf' THEN 2000 ELSE 4000 END AS cap FROM files")
def p2_cap_of_category(spark, sf_dir):
    paged = F.coalesce(admission.category(F.col("extension")).isin(admission.PAGED), F.lit(False))
    return collection.files(spark, sf_dir).select("file_id", F.when(paged, 2000).otherwise(4000).alias("cap"))


@query(f"WITH {PAGES_SQL} SELECT file_id, number, length(trim(text)) = 0 AS blank, role = 'system' AND length(text) < 100 AS needs_ocr FROM pages_")
def p6_blank_page(spark, sf_dir):
    return collection.pages(spark, sf_dir).select("file_id", "number", (F.length(F.trim("text")) == 0).alias("blank"), ((F.col("role") == "system") & (F.length("text") < 100)).alias("needs_ocr"))


@query(f"WITH {FILES_SQL}, r AS (SELECT group_key, min(regexp_replace(relative_path, '/[^/]*$', '/')) AS root FROM files WHERE file_id % 8 = 0 GROUP BY group_key) SELECT file_id, extension = 'html' AND root IS NOT NULL AND starts_with(relative_path, root) AS legislation FROM files LEFT JOIN r USING (group_key)")
def p7_legislation(spark, sf_dir):
    files = collection.files(spark, sf_dir)
    roots = files.filter("file_id % 8 = 0").groupBy("group_key").agg(F.min(F.regexp_replace("relative_path", "/[^/]*$", "/")).alias("root"))
    under = (F.col("extension") == "html") & F.col("root").isNotNull() & F.col("relative_path").startswith(F.col("root"))
    return files.join(roots, "group_key", "left").select("file_id", under.alias("legislation"))


@query(f"WITH {ITEMS_SQL}, {SIZES_SQL} SELECT line, start_order, start_order >= 1 AND end_order <= coalesce(pages, 0) AND start_order <= end_order AS inside FROM items LEFT JOIN sizes USING (group_key)")
def p12_range_check(spark, sf_dir):
    inside = (F.col("start_order") >= 1) & (F.col("end_order") <= F.coalesce("pages", F.lit(0))) & (F.col("start_order") <= F.col("end_order"))
    return collection.items(spark, sf_dir).join(collection.group_sizes(spark, sf_dir), "group_key", "left").select("line", "start_order", inside.alias("inside"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'low' ELSE ['high', 'low', 'medium'][event_id % 3 + 1] END AS confidence FROM events")
def p15_confidence(spark, sf_dir):
    raw = F.when(F.col("event_type").isin("click", "view"), "certain").otherwise(F.get(F.array(F.lit("high"), F.lit("low"), F.lit("medium")), (F.col("event_id") % 3).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", t.normal_confidence(raw).alias("confidence"))


@query(f"WITH {FILES_SQL} SELECT file_id, CASE WHEN extension IN ('zip', 'mp3', 'pem', 'gdoc', 'exe') THEN 'skipped' WHEN EXISTS (SELECT 1 FROM labels WHERE doc_id = file_id) THEN 'extracted' ELSE 'discovered' END AS status FROM files")
def p17_status(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_id")).distinct().withColumn("done", F.lit(True))
    reason = admission.name_decision(F.col("name"))
    return collection.files(spark, sf_dir).join(done, "file_id", "left").select("file_id", F.when(reason.isNotNull(), "skipped").when(F.col("done"), "extracted").otherwise("discovered").alias("status"))


@query("SELECT l.doc_id, d.source, l.quality FROM labels l JOIN documents d USING (doc_id)")
def j2_hits_with_files(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id").select("doc_id", "source", "quality")


@query("SELECT (SELECT count(*) FROM labels l JOIN documents d USING (doc_id)) AS indexed, (SELECT count(*) FROM documents) AS extracted")
def j3_index_coverage(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    return docs.agg(F.count("hit").alias("indexed"), F.count_distinct("doc_id").alias("extracted"))


@query(f"WITH {PAGES_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY file_id, number) AS pos FROM pages_) SELECT group_key, pos, path, number FROM p WHERE pos IN (1, 5, 9)")
def j13_point_lookup(spark, sf_dir):
    places = ordered.positions(collection.pages(spark, sf_dir), ["group_key"], ["file_id", "number"])
    wanted = spark.createDataFrame([(1,), (5,), (9,)], "pos long")
    return places.join(F.broadcast(wanted), "pos").select("group_key", "pos", "path", "number")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def j24_page_text(spark, sf_dir):
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


@query(f"WITH {ITEMS_SQL} SELECT group_key, avg(CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.6 ELSE 0.2 END) AS confidence, CASE WHEN count(date) / CAST(count(*) AS DOUBLE) >= 0.05 THEN (count(type) + count(date)) / (2.0 * count(*)) ELSE count(type) / CAST(count(*) AS DOUBLE) END AS fill FROM items GROUP BY group_key")
def a4_confidence_and_fill(spark, sf_dir):
    level = F.when(F.col("confidence") == "high", 1.0).when(F.col("confidence") == "medium", 0.6).otherwise(0.2)
    n, typed, dated = F.count("*"), F.count("type"), F.count("date")
    fill = F.when(dated / n >= 0.05, (typed + dated) / (2.0 * n)).otherwise(typed / n)
    return collection.items(spark, sf_dir).groupBy("group_key").agg(F.avg(level).alias("confidence"), fill.alias("fill"))


@query(f"WITH {FILES_SQL} SELECT group_key, CAST(coalesce(sum(CASE WHEN extension = 'pdf' THEN size END), 0) AS BIGINT) AS pdf_bytes FROM files GROUP BY group_key")
def a10_sum_with_default(spark, sf_dir):
    return collection.files(spark, sf_dir).groupBy("group_key").agg(F.coalesce(F.sum(F.when(F.col("extension") == "pdf", F.col("size"))), F.lit(0)).alias("pdf_bytes"))


@query(f"WITH {ITEMS_SQL}, f AS (SELECT group_key, start_order, arg_min(type, line) FILTER (type IS NOT NULL) AS type, arg_min(date, line) FILTER (date IS NOT NULL) AS date FROM (SELECT group_key, start_order, line, min(type) AS type, min(date) AS date FROM items GROUP BY ALL) GROUP BY group_key, start_order) SELECT * FROM f")
def a13_first_known(spark, sf_dir):
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("line", c)))
    return collection.items(spark, sf_dir).groupBy("group_key", "start_order").agg(first("type").alias("type"), first("date").alias("date"))


@query(f"WITH {FILES_SQL}, x AS (SELECT extension, name, row_number() OVER (PARTITION BY extension ORDER BY name) AS r, count(*) OVER (PARTITION BY extension) AS n FROM files) SELECT extension, max(n) AS n, list(name ORDER BY name) AS first_names FROM x WHERE r <= 10 GROUP BY extension")
def a20_first_ten_names(spark, sf_dir):
    files = collection.files(spark, sf_dir).select("extension", "name")
    top = files.withColumn("r", F.row_number().over(Window.partitionBy("extension").orderBy("name"))).filter("r <= 10")
    return top.groupBy("extension").agg(F.array_sort(F.collect_list("name")).alias("first_names")).join(files.groupBy("extension").agg(F.count("*").alias("n")), "extension")


@query("SELECT source, sum(quality) AS hits, count(quality) AS total, CASE WHEN count(quality) > 0 THEN sum(quality) / CAST(count(quality) AS DOUBLE) END AS rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def a23_rates(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.sum("quality").alias("hits"), F.count("quality").alias("total"), F.try_divide(F.sum("quality"), F.count("quality")).alias("rate"))


@query("SELECT doc_id, length(regexp_replace(text, '[^A-Za-zÀ-ÖØ-öø-ɏ]', '', 'g')) AS latin, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits FROM documents")
def a27_script_histogram(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.script_counts(F.col("text"))["latin"].alias("latin"), F.length(F.regexp_replace("text", "[^0-9]", "")).alias("digits"))


@query(f"""WITH {PAGES_SQL}, h AS (SELECT file_id, number, role, lag(role) OVER w AS before FROM pages_ WINDOW w AS (PARTITION BY file_id ORDER BY number)), r AS (SELECT *, sum(CASE WHEN before IS DISTINCT FROM role THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY number) AS run FROM h),
c AS (SELECT file_id, run, role, count(*) AS n, min(number) AS first FROM r GROUP BY ALL) SELECT file_id, first, coalesce(lag(n) OVER (PARTITION BY file_id ORDER BY run) >= 2, false) AS header_changed FROM c""")
def w6_header_runs(spark, sf_dir):
    rows = ordered.islands(collection.pages(spark, sf_dir), ["file_id"], ["number"], F.col("role") != F.col("before"), {"before": "role"}, "run")
    runs = rows.groupBy("file_id", "run").agg(F.count("*").alias("n"), F.min("number").alias("first"))
    return ordered.previous(runs, ["file_id"], ["run"], {"seen": "n"}).select("file_id", "first", F.coalesce(F.col("seen") >= 2, F.lit(False)).alias("header_changed"))


@query("SELECT item_id, text FROM benchmark WHERE contains(text, 'the') ORDER BY length(text) DESC, item_id LIMIT 10 OFFSET 5")
def o2_page_of_hits(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").filter(F.col("text").contains("the")).orderBy(F.desc(F.length("text")), "item_id").offset(5).limit(10).select("item_id", "text")


@query(f"WITH {ITEMS_SQL} SELECT group_key, start_order, end_order, line FROM items WHERE confidence = 'low' ORDER BY group_key, start_order, end_order, line")
def o4_ordered_review(spark, sf_dir):
    return collection.items(spark, sf_dir).filter("confidence = 'low'").select("group_key", "start_order", "end_order", "line").orderBy("group_key", "start_order", "end_order", "line")


@query("SELECT c_custkey, ['日本語 text', '中文字', 'a b', '한국 어'][c_custkey % 4 + 1] AS text FROM customer")
def f7_collapse_unspaced(spark, sf_dir):
    wide = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}]"
    raw = F.get(F.array(*[F.lit(x) for x in ("日 本 語 text", "中 文字", "a b", "한국 어")]), (F.col("c_custkey") % 4).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.regexp_replace(raw, rf"(?<={wide})\s+(?={wide})", "").alias("text"))


@query("SELECT c_custkey, ['Art. 5º', 'CAPÍTULO II', 'Title here', NULL][c_custkey % 4 + 1] AS heading FROM customer")
def f11_heading(spark, sf_dir):
    raw = F.get(F.array(*[F.lit(x) for x in ("~~Art. 5º O texto", "## CAPÍTULO  II", "# Title here", "plain Art. 5")]), (F.col("c_custkey") % 4).cast("int"))
    act = F.regexp_extract(raw, r"^(?:~~)?\s*(?:#+\s*)?(Art\.?\s*\d+[º°]?(?:-[A-Z])?|(?:CAP[ÍI]TULO|T[ÍI]TULO|LIVRO|PARTE|SE[ÇC][ÃA]O)\s+[IVXLCDM\d]+[A-Z-]*|ANEXO(?:\s+[IVXLCDM\d]+)?)", 1)
    mark = F.regexp_extract(raw, r"^#+\s+(.{1,80})", 1)
    found = F.coalesce(F.nullif(F.regexp_replace(act, r"\s+", " "), F.lit("")), F.nullif(F.trim(mark), F.lit("")))
    return table(spark, sf_dir, "customer").select("c_custkey", found.alias("heading"))


@query("SELECT doc_id, (len(string_split(substr(t, 1, instr(t, 'x9') - 1), '~~')) - 1) % 2 = 1 AS struck FROM (SELECT doc_id, repeat('~~a', CAST(doc_id % 4 AS INT)) || 'x9' AS t FROM documents)")
def f15_struck_hit(spark, sf_dir):
    raw = F.concat(F.expr("repeat('~~a', cast(doc_id % 4 as int))"), F.lit("x9"))
    before = F.substring(raw, F.lit(1), F.instr(raw, "x9") - 1)
    return _docs(spark, sf_dir).select("doc_id", (F.regexp_count(before, F.lit("~~")) % 2 == 1).alias("struck"))


@query("SELECT doc_id, regexp_matches(text, '(?i)scum|worthless|pathetic') AS stamped FROM documents")
def f18_protocol(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.any_of(F.col("text"), ["scum", "worthless", "pathetic"]).alias("stamped"))


@query("SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 40)[1] AS summary FROM documents")
def f20_first_sentence(spark, sf_dir):
    parts = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\u0001"), "\u0001")
    return _docs(spark, sf_dir).select("doc_id", F.get(F.filter(parts, lambda x: F.length(F.trim(x)) > 40), F.lit(0)).alias("summary"))


@query("SELECT p_partkey, '13.' || p_partkey AS number, 'Sobre ' || p_name AS ementa FROM part")
def f26_split_norm(spark, sf_dir):
    raw = F.concat(F.lit("LEI Nº 13."), "p_partkey", F.lit(": Sobre "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_extract(raw, r"N[º°]\s*([\d.]+)", 1).alias("number"), F.regexp_extract(raw, r"(?s):\s*(.*)$", 1).alias("ementa"))


@query("SELECT p_partkey, 'g' || p_partkey AS base, CAST(p_partkey % 90 + 1 AS BIGINT) AS first, CAST(p_partkey % 90 + 16 AS BIGINT) AS last FROM part")
def f29_window_key_parts(spark, sf_dir):
    k = F.col("p_partkey")
    key = t.window_key(F.concat(F.lit("g"), k.cast("string")), k % 90 + 1, k % 90 + 16)
    part = lambda i: F.regexp_extract(key, r"^(.*)::(\d+)-(\d+)$", i)
    return table(spark, sf_dir, "part").select("p_partkey", part(1).alias("base"), part(2).cast("long").alias("first"), part(3).cast("long").alias("last"))


@query("""WITH w AS (SELECT c.conv_id, c.turn, list_filter(regexp_split_to_array(lower(strip_accents(c.text)), '[^\\p{L}\\p{N}]+'), lambda x: length(x) > 3)[1:2] AS s FROM conversations c) SELECT conv_id, turn, coalesce(len(s) > 0 AND s = lag(s) OVER (PARTITION BY conv_id ORDER BY turn), false) AS same_start FROM w""")
def f35_same_topic_start(spark, sf_dir):
    rows = t.settled(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), s=F.slice(F.filter(t.words(F.col("text")), lambda w: F.length(w) > 3), 1, 2)).drop("text")
    return ordered.previous(rows, ["conv_id"], ["turn"], {"before": "s"}).select("conv_id", "turn", F.coalesce((F.size("s") > 0) & (F.col("s") == F.col("before")), F.lit(False)).alias("same_start"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 END AS rows_found FROM events")
def f41_model_rows(spark, sf_dir):
    raw = F.get(F.array(*[F.lit(x) for x in ('[{"n":1},{"n":2}]', '{"pages":[{"n":1}]}', '{"items":[{"n":"1"}]}', "no json")]), (F.col("event_id") % 4).cast("int"))
    kind = "array<struct<n:string>>"
    wrapped = F.from_json(raw, f"pages {kind}, items {kind}")
    rows = F.coalesce(F.when(F.ltrim(raw).startswith("["), F.from_json(raw, kind)), wrapped["pages"], wrapped["items"])
    return table(spark, sf_dir, "events").select("event_id", F.when(rows.isNotNull(), F.size(rows)).alias("rows_found"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace('../a<b>:' || p_name || '?.pdf', '[<>:\"/\\\\|?*]+', '_', 'g'), '^[. ]+|[. ]+$', '', 'g')) AS safe FROM part")
def f43_attachment_name(spark, sf_dir):
    raw = F.concat(F.lit("../a<b>:"), "p_name", F.lit("?.pdf"))
    return table(spark, sf_dir, "part").select("p_partkey", F.trim(F.regexp_replace(F.regexp_replace(raw, r'[<>:"/\\|?*]+', "_"), r"^[. ]+|[. ]+$", "")).alias("safe"))


@query("SELECT s_suppkey, CAST(greatest(1, least(size - 1, floor(size * 0.125))) AS BIGINT) AS overlap FROM (SELECT s_suppkey, s_suppkey % 30 + 2 AS size FROM supplier)")
def f45_overlap(spark, sf_dir):
    size = F.col("s_suppkey") % 30 + 2
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.greatest(F.lit(1), F.least(size - 1, F.floor(size * 0.125))).cast("long").alias("overlap"))


@query(f"WITH {FILES_SQL} SELECT file_id, CASE WHEN EXISTS (SELECT 1 FROM labels WHERE doc_id = file_id) THEN 'converted' ELSE 'discovered' END AS status FROM files WHERE extension = 'pdf'")
def t17_renumber_status(spark, sf_dir):
    kept = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_id")).distinct().withColumn("there", F.lit(True))
    return collection.files(spark, sf_dir).filter("extension = 'pdf'").join(kept, "file_id", "left").select("file_id", F.when(F.col("there"), "converted").otherwise("discovered").alias("status"))


@query(f"WITH {FILES_SQL}, s AS (SELECT size FROM files GROUP BY size HAVING count(*) > 1) SELECT file_id, sha256 FROM files WHERE size IN (SELECT size FROM s)")
def t2_hash_only_taken_sizes(spark, sf_dir):
    """Only files whose size is taken are hashed: the semi-join stands before the hash."""
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("file_id"), F.col("n_chars").alias("size"), "text")
    taken = docs.groupBy("size").agg(F.count("*").alias("n")).filter("n > 1").select("size")
    return docs.join(taken, "size", "left_semi").select("file_id", F.sha2("text", 256).alias("sha256"))


@query(f"WITH {FILES_SQL} SELECT group_key, count(*) FILTER (file_id % 11 = 0) AS new, count(*) FILTER (file_id % 13 = 0) AS changed, min(file_id) FILTER (file_id % 13 = 0) AS first_changed, CAST(sum(size) FILTER (file_id % 13 = 0 OR file_id % 11 = 0) AS BIGINT) AS cost FROM files GROUP BY group_key")
def t1_update_plan(spark, sf_dir):
    k = F.col("file_id")
    moved = (k % 13 == 0) | (k % 11 == 0)
    return collection.files(spark, sf_dir).groupBy("group_key").agg(
        F.count_if(k % 11 == 0).alias("new"), F.count_if(k % 13 == 0).alias("changed"), F.min(F.when(k % 13 == 0, k)).alias("first_changed"), F.sum(F.when(moved, F.col("size"))).alias("cost"),
    )


@query("""WITH h AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+'), lambda x: x = 'the')) AS tf FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY tf DESC, turn) AS r, max(tf) OVER (PARTITION BY conv_id) AS best FROM h WHERE tf > 0)
SELECT conv_id, turn, tf, r FROM r WHERE r <= 3 ORDER BY best DESC, conv_id, r""")
def x5_search_by_file(spark, sf_dir):
    """Up to three excerpts of each file, files by their best hit."""
    rows = t.settled(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), w=t.words(F.col("text")))
    hits = rows.select("conv_id", "turn", F.size(F.filter("w", lambda x: x == "the")).cast("long").alias("tf")).filter("tf > 0")
    best = hits.groupBy("conv_id").agg(F.max("tf").alias("best"))
    top = hits.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("tf"), "turn"))).filter("r <= 3")
    return top.join(best, "conv_id").orderBy(F.desc("best"), "conv_id", "r").select("conv_id", "turn", "tf", "r")


@query()
def x2_passage_index(spark, sf_dir):
    """Postings of the passages of all documents; passages are checked in the tests, postings by x1."""
    return search.postings(search.passages(_docs(spark, sf_dir)), ["doc_id", "seq"]).select("doc_id", "seq", "term", "tf", "dl")


@query(f"""WITH {FILES_SQL}, p AS (SELECT extension, size, row_number() OVER (PARTITION BY extension ORDER BY size) AS r, count(*) OVER (PARTITION BY extension) AS n FROM files) SELECT extension, max(n) AS n, max(size) FILTER (r = CAST(floor(0.75 * (n - 1)) AS BIGINT) + 1) AS p75, CASE WHEN extension = 'pdf' THEN 16 ELSE 8 END AS window_size FROM p GROUP BY extension""")
def x16_settings_inference(spark, sf_dir):
    counts = collection.files(spark, sf_dir).groupBy("extension", "size").agg(F.count("*").alias("c"))
    run = ordered.running_sum(counts, ["extension"], ["size"], "c", "upto").join(counts.groupBy("extension").agg(F.sum("c").alias("n")), "extension")
    at = run.filter(F.col("upto") > F.floor(0.75 * (F.col("n") - 1))).groupBy("extension", "n").agg(F.min("size").alias("p75"))
    return at.select("extension", "n", "p75", F.when(F.col("extension") == "pdf", 16).otherwise(8).alias("window_size"))

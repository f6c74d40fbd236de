"""Queries on what the other modules leave: merges, spreads, names, sections, accuracy, copies, requeues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import ordered, pieces, upkeep
from ..sources import collection
from ..sources.collection import FILES_SQL, ITEMS_SQL, PAGES_SQL, table
from .piece_queries import _key_and_rest
from .registry import query


@query(f"WITH {ITEMS_SQL} SELECT group_key, count(*) FILTER (coalesce(trim(type), '') = '') AS no_type, count(*) FILTER (coalesce(trim(date), '') = '') AS no_date, count(*) FILTER (coalesce(trim(author), '') = '') AS no_author FROM items GROUP BY group_key")
def a3_blank_counts(spark, sf_dir):
    blank = lambda c: F.count_if(F.coalesce(F.trim(c), F.lit("")) == "").alias(f"no_{c}")
    return collection.items(spark, sf_dir).groupBy("group_key").agg(blank("type"), blank("date"), blank("author"))


@query(f"WITH {ITEMS_SQL} SELECT type, count(*) AS n, count(date) AS dated, CASE WHEN count(date) / CAST(count(*) AS DOUBLE) >= 0.7 THEN count(date) / CAST(count(*) AS DOUBLE) END AS date_rate FROM items GROUP BY type")
def a5_conditional_fill(spark, sf_dir):
    rate = F.count("date") / F.count("*")
    return collection.items(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.count("date").alias("dated"), F.when(rate >= 0.7, rate).alias("date_rate"))


@query(f"WITH {FILES_SQL}, {ITEMS_SQL} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(DISTINCT group_key) FROM items) AS groups, (SELECT count(*) FROM items) AS pieces")
def a28_state_triple(spark, sf_dir):
    files, items = collection.files(spark, sf_dir), collection.items(spark, sf_dir)
    by_group = items.groupBy("group_key").agg(F.count("*").alias("n"))
    counted = files.agg(F.count("*").alias("v")).select(F.lit("files").alias("k"), "v").unionByName(by_group.agg(F.count("*").alias("v")).select(F.lit("groups").alias("k"), "v"))
    every = counted.unionByName(by_group.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("v")).select(F.lit("pieces").alias("k"), "v"))
    return every.agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in ("files", "groups", "pieces")])


@query(f"""WITH {ITEMS_SQL}, p AS (SELECT group_key, start_order, line, type, date, confidence, lead(line) OVER w AS l2, lead(type) OVER w AS t2, lead(date) OVER w AS d2, lead(confidence) OVER w AS c2 FROM (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY line ORDER BY group_key, start_order, end_order, type NULLS FIRST, date NULLS FIRST, confidence) = 1) WINDOW w AS (PARTITION BY group_key, start_order ORDER BY line))
SELECT line, CASE WHEN array_position(['low', 'medium', 'high'], c2) > array_position(['low', 'medium', 'high'], confidence) THEN coalesce(t2, type) ELSE coalesce(type, t2) END AS type,
    CASE WHEN array_position(['low', 'medium', 'high'], c2) > array_position(['low', 'medium', 'high'], confidence) THEN coalesce(d2, date) ELSE coalesce(date, d2) END AS date FROM p WHERE l2 IS NOT NULL""")
def w10_pairwise_merge(spark, sf_dir):
    """The better confidence gives the fields, the first on ties; empty ones are filled from the other."""
    one = collection.items(spark, sf_dir).groupBy("line").agg(F.min(F.struct("group_key", "start_order", "end_order", "type", "date", "confidence")).alias("x")).select("line", "x.*")
    rows = ordered.previous(one.withColumn("back", -F.col("line")), ["group_key", "start_order"], ["back"], {"l2": "line", "t2": "type", "d2": "date", "c2": "confidence"}).filter("l2 is not null")
    level = lambda c: F.array_position(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col(c))
    fill = lambda a, b: F.when(level("c2") > level("confidence"), F.coalesce(b, a)).otherwise(F.coalesce(a, b))
    return rows.select("line", fill("type", "t2").alias("type"), fill("date", "d2").alias("date"))


@query(f"""WITH {PAGES_SQL}, s AS (SELECT file_id, number, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY number) AS act FROM pages_)
SELECT file_id, CAST(act AS BIGINT) AS act, min(number) AS first, max(number) AS last FROM s WHERE act > 0 GROUP BY file_id, act""")
def w22_spread_acts(spark, sf_dir):
    """An act runs from its title page (here: a user's message) to the page before the next one of the file."""
    rows = ordered.running_sum(collection.pages(spark, sf_dir).withColumn("opens", (F.col("role") == "user").cast("long")), ["file_id"], ["number"], "opens", "act")
    return rows.filter("act > 0").groupBy("file_id", "act").agg(F.min("number").alias("first"), F.max("number").alias("last"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS sec, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'error'),
f AS (SELECT user_id, rn, sec, value AS rate FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.rn, e.sec, exp(-(e.sec - f.sec) / 45000.0) * f.rate + (1 - exp(-(e.sec - f.sec) / 45000.0)) * e.value FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT user_id, round(rate, 6) AS rate FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1""")
def w23_decayed_rate(spark, sf_dir):
    """Exponentially weighted rate by time: a weighted sum, since each value keeps exp(-(end - at) / tau) of its weight at the end."""
    tau = 45000.0
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'").select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    held = ordered.previous(rows, ["user_id"], ["ts", "event_id"], {"was": "us"})
    end = rows.groupBy("user_id").agg(F.max("us").alias("end"))
    gain = F.when(F.col("was").isNull(), F.lit(1.0)).otherwise(1 - F.exp(-(F.col("us") - F.col("was")) / 1e6 / tau))
    return held.join(end, "user_id").groupBy("user_id").agg(F.round(F.sum(gain * F.col("value") * F.exp(-(F.col("end") - F.col("us")) / 1e6 / tau)), 6).alias("rate"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'jpn' WHEN 1 THEN 'kor' WHEN 2 THEN 'chi' END AS language FROM customer")
def f8_east_asian(spark, sf_dir):
    raw = F.get(F.array(*[F.lit(x) for x in ("これは日本語です", "한국어 문서", "中文文件没有假名", "plain")]), (F.col("c_custkey") % 4).cast("int"))
    n = t.script_counts(raw)
    east = n["han"] + n["kana"]
    lang = F.when((n["hangul"] > 0) & (n["hangul"] >= east), "kor").when((east > 0) & (n["kana"] >= 0.05 * east), "jpn").when(east > 0, "chi")
    return table(spark, sf_dir, "customer").select("c_custkey", lang.alias("language"))


_STOP = {"de": ["der", "die", "und", "den", "von", "mit"], "en": ["the", "of", "and", "to", "in", "that"], "es": ["el", "los", "que", "del", "una", "por"], "fr": ["le", "les", "des", "et", "une", "dans"]}


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-zà-öø-ÿß]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, [(len(list_filter(w, lambda x: x IN ('der', 'die', 'und', 'den', 'von', 'mit'))), -0, 'de'), (len(list_filter(w, lambda x: x IN ('the', 'of', 'and', 'to', 'in', 'that'))), -1, 'en'),
    (len(list_filter(w, lambda x: x IN ('el', 'los', 'que', 'del', 'una', 'por'))), -2, 'es'), (len(list_filter(w, lambda x: x IN ('le', 'les', 'des', 'et', 'une', 'dans'))), -3, 'fr')] AS c FROM w)
SELECT doc_id, CASE WHEN list_max(list_transform(c, lambda x: x[1])) > 0 THEN list_sort(list_transform(c, lambda x: (x[1] * 10 + x[2], x[3])))[4][2] END AS language FROM c""")
def f9_function_words_language(spark, sf_dir):
    """Language by counts of function words; ties go to the language listed first."""
    rows = t.settled(table(spark, sf_dir, "documents").select("doc_id", "text"), w=F.filter(F.split(F.lower("text"), "[^a-zà-öø-ÿß]+"), lambda x: x != ""))
    known = lambda ws: F.size(F.filter("w", lambda x: x.isin(ws)))
    scored = F.array(*[F.struct(known(ws).alias("n"), F.lit(-k).alias("k"), F.lit(lang).alias("lang")) for k, (lang, ws) in enumerate(_STOP.items())])
    return rows.select("doc_id", F.array_max(scored).alias("x")).select("doc_id", F.when(F.col("x.n") > 0, F.col("x.lang")).alias("language"))


@query("SELECT doc_id, contains(text, '50%_x') AS hit FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN '50%_x' ELSE '50 x' END AS text FROM documents)")
def f13_literal_pattern(spark, sf_dir):
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "50%_x").otherwise("50 x"))
    return table(spark, sf_dir, "documents").select("doc_id", text.contains("50%_x").alias("hit"))


@query("SELECT s_suppkey, ['LAW', NULL, 'DECREE', NULL][s_suppkey % 4 + 1] AS type FROM supplier")
def f17_heading_type(spark, sf_dir):
    raw = F.get(F.array(*[F.lit(x) for x in ("# LAW No 5\nDECREE No 1", "under the law no 5", "intro\nDECREE No 7", "x" * 700 + "\nLAW No 1")]), (F.col("s_suppkey") % 4).cast("int"))
    head = F.substring(raw, 1, 600)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.when(head.rlike(r"(?m)^[#\s]*LAW\s+N"), "LAW").when(head.rlike(r"(?m)^[#\s]*DECREE\s+N"), "DECREE").alias("type"))


@query("SELECT s_suppkey, ['Ana Maria da Silva', 'João de Souza e Castro', 'Pedro II', NULL][s_suppkey % 4 + 1] AS name FROM supplier")
def f24_person_name(spark, sf_dir):
    raw = F.get(F.array(*[F.lit(x) for x in ("ANA MARIA DA SILVA", "JOÃO DE SOUZA E CASTRO", "PEDRO II", None)]), (F.col("s_suppkey") % 4).cast("int"))
    word = lambda w: F.when(w.isin("da", "de", "do", "das", "dos", "e"), w).when(w.rlike("^[ivxlcdm]+$"), F.upper(w)).otherwise(F.initcap(w))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(F.transform(F.split(F.lower(raw), r"\s+"), word), " ").alias("name"))


@query("""WITH l AS (SELECT conv_id, turn, turn % 3 + 1 AS level FROM conversations) SELECT a.conv_id, a.turn, a.level, min(b.turn) AS ends FROM l a LEFT JOIN l b ON a.conv_id = b.conv_id AND b.turn > a.turn AND b.level <= a.level GROUP BY ALL""")
def f40_section_tree(spark, sf_dir):
    """Where each section ends: at the next heading of its level or a higher one. A document's headings meet only each other."""
    heads = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") % 3 + 1).alias("level"))
    lists = heads.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "level"))).alias("h"))
    rows = lists.select("conv_id", F.explode("h").alias("x"), "h")
    ends = F.array_min(F.transform(F.filter("h", lambda y: (y["turn"] > F.col("x.turn")) & (y["level"] <= F.col("x.level"))), lambda y: y["turn"]))
    return rows.select("conv_id", "x.turn", "x.level", ends.alias("ends"))


@query("""WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 3 <> 1 THEN turn + 1 END AS n, text FROM conversations), u AS (SELECT conv_id, n, arg_min(text, turn) AS text FROM r WHERE n IS NOT NULL GROUP BY ALL),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, text FROM r WHERE n IS NULL), m AS (SELECT c.conv_id, c.turn + 1 AS page FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.conv_id = c.conv_id AND u.n = c.turn + 1)),
mk AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY page) AS k FROM m) SELECT conv_id, n AS page, text FROM u UNION ALL SELECT mk.conv_id, page, text FROM mk LEFT JOIN o USING (conv_id, k)""")
def f42_row_alignment(spark, sf_dir):
    """Rows go to the page that they name, first one wins; rows without a number fill the pages that are left, in order."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 != 1, F.col("turn") + 1).alias("n"), "text")
    named = rows.filter("n is not null").groupBy("conv_id", "n").agg(F.min_by("text", "turn").alias("text")).withColumnRenamed("n", "page")
    free = rows.select("conv_id", (F.col("turn") + 1).alias("page")).join(named, ["conv_id", "page"], "left_anti")
    spare = ordered.positions(rows.filter("n is null").select("conv_id", "turn", "text"), ["conv_id"], ["turn"], "k").select("conv_id", "k", "text")
    filled = ordered.positions(free, ["conv_id"], ["page"], "k").join(spare, ["conv_id", "k"], "left").select("conv_id", "page", "text")
    return named.select("conv_id", "page", "text").unionByName(filled)


@query(f"WITH {FILES_SQL} SELECT file_id, CASE WHEN file_id % 6 = 0 THEN 'component_unavailable' END IS NOT NULL AND extension = 'docx' AS waiting FROM files")
def p8_waiting(spark, sf_dir):
    error = F.when(F.col("file_id") % 6 == 0, "component_unavailable")
    return collection.files(spark, sf_dir).select("file_id", (F.col("extension").eqNullSafe("docx") & error.eqNullSafe("component_unavailable")).alias("waiting"))


@query()
def x14_accuracy_report(spark, sf_dir):
    """Pieces of the key and the index matched one to one, then counted: rates of match, type and date, and F1."""
    key, index = _key_and_rest(spark, sf_dir)
    fields = collection.items(spark, sf_dir).groupBy("line").agg(F.min(F.struct("group_key", "start_order", "end_order", "type", "date")).alias("f"))
    of = lambda name, n: fields.select(F.col("line").alias(name), F.col("f.type").alias(f"type{n}"), F.col("f.date").alias(f"date{n}"))
    matched = pieces.matched(key, index).join(of("key_id", 1), "key_id").join(of("index_id", 2), "index_id")
    hits = matched.agg(
        F.count("*").alias("matched"), F.count_if(F.col("type1").eqNullSafe(F.col("type2"))).alias("type_hits"), F.count("date1").alias("dated"), F.count_if(F.col("date1") == F.col("date2")).alias("date_hits"),
    )
    n, m = key.count(), index.count()
    return hits.select("*", F.lit(n).alias("key_pieces"), F.lit(m).alias("index_pieces"), F.try_divide(2 * F.col("matched"), F.lit(n + m)).alias("f1"))


@query("""WITH dw AS (SELECT doc_id AS id, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id AS id, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM benchmark),
dg AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM dw WHERE len(w) >= 3), bg AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM bw WHERE len(w) >= 3)
SELECT id AS item_id, count(dg.g) / CAST(count(*) AS DOUBLE) >= 0.8 AND count(*) >= 4 AS copied FROM bg LEFT JOIN dg USING (g) GROUP BY id""")
def x15_copied_sections(spark, sf_dir):
    """Texts of which at least four fifths of the word trigrams (four or more) stand in the collection."""
    tokens = lambda df: t.settled(df, w=F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")).filter(F.size("w") >= 3)
    have = tokens(table(spark, sf_dir, "documents").select("text")).select(F.explode(t.word_ngrams(F.col("w"), 3)).alias("g")).distinct().withColumn("hit", F.lit(1))
    own = tokens(table(spark, sf_dir, "benchmark").select("item_id", "text")).select("item_id", F.explode(t.word_ngrams(F.col("w"), 3)).alias("g"))
    return own.join(have, "g", "left").groupBy("item_id").agg(((F.count("hit") / F.count("*") >= 0.8) & (F.count("*") >= 4)).alias("copied"))


@query(f"WITH {FILES_SQL} SELECT file_id, CASE WHEN EXISTS (SELECT 1 FROM conversations WHERE conv_id = file_id) THEN 'held' ELSE 'requeued' END AS state FROM files WHERE file_id % 5 = 0")
def t8_requeue_failures(spark, sf_dir):
    """Failed files are queued again, apart from those whose group already has windows."""
    held = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id")).distinct().withColumn("h", F.lit(True))
    return collection.files(spark, sf_dir).filter("file_id % 5 = 0").join(held, "file_id", "left").select("file_id", F.when(F.col("h"), "held").otherwise("requeued").alias("state"))


@query(f"WITH {ITEMS_SQL} SELECT line, confidence FROM items WHERE NOT (confidence = 'low' AND group_key IN (SELECT group_key FROM items WHERE line % 1000 = 0))")
def t18_drop_fallback_lines(spark, sf_dir):
    rows = collection.items(spark, sf_dir)
    pending = rows.filter("line % 1000 = 0").select("group_key").distinct()
    return rows.filter("confidence <> 'low'").select("line", "confidence").unionByName(upkeep.without(rows.filter("confidence = 'low'"), pending, ["group_key"]).select("line", "confidence"))

"""Queries on scalar functions, predicates, sets, sorts and search (F, P, U, O, X)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as t
from ..operators import ordered, pieces, search
from ..sources import collection
from ..sources.collection import FILES_SQL, ITEMS_SQL, PAGES_SQL, SIZES_SQL, table
from .registry import query


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


# --- functions -------------------------------------------------------------------------------


@query(f"WITH {FILES_SQL} SELECT file_id, list_transform(string_split(regexp_replace(lower(relative_path), '(\\d+)', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x: CASE WHEN regexp_matches(x, '^\\d+$') THEN lpad(x, 20, '0') ELSE x END) AS key FROM files")
def f1_natural_key(spark, sf_dir):
    return collection.files(spark, sf_dir).select("file_id", t.natural_key(F.col("relative_path")).alias("key"))


@query("SELECT doc_id, md5(regexp_replace(translate(text, 'áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ', 'aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN'), '[^A-Za-z]', '', 'g')) AS folded FROM documents")
def f2_accent_fold(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(F.regexp_replace(t.fold(F.col("text")), "[^A-Za-z]", "")).alias("folded"))


@query("SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^A-Za-zÀ-ÖØ-öø-ɏ]', '', 'g')) > 0 THEN 'latin' END AS script, length(regexp_replace(text, '[^A-Za-zÀ-ÖØ-öø-ɏ]', '', 'g')) AS latin FROM documents")
def f6_dominant_script(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.dominant_script(F.col("text")).alias("script"), t.script_counts(F.col("text"))["latin"].alias("latin"))


@query("SELECT doc_id, coalesce(CASE WHEN regexp_matches(text, '(\\d+)\\s*$') THEN TRY_CAST(regexp_extract(text, '(\\d+)\\s*$', 1) AS BIGINT) END) AS number FROM (SELECT doc_id, 'f. ' || doc_id || CASE WHEN doc_id % 3 = 0 THEN ' ' WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END AS text FROM documents)")
def f28_reference_number(spark, sf_dir):
    label = F.concat(F.lit("f. "), F.col("doc_id"), F.when(F.col("doc_id") % 3 == 0, " ").when(F.col("doc_id") % 5 == 0, "x").otherwise(""))
    return _docs(spark, sf_dir).select("doc_id", t.reference_number(label).alias("number"))


@query(f"WITH {FILES_SQL} SELECT file_id, regexp_replace(relative_path, '[^\\w\\-]+', '_', 'g') AS safe, trim(regexp_replace(lower(relative_path), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM files")
def f30_safe_names(spark, sf_dir):
    return collection.files(spark, sf_dir).select("file_id", t.window_base(F.col("relative_path")).alias("safe"), t.slug(F.col("relative_path")).alias("slug"))


@query("SELECT doc_id, coalesce(nullif(trim(replace(regexp_replace(CASE WHEN doc_id % 7 <> 0 THEN substr(text, 1, 300) ELSE ' ' END, '\\s*\\n\\s*', ' ', 'g'), '|', '\\|')), ''), '—') AS cell FROM documents")
def f33_markdown_cell(spark, sf_dir):
    value = F.when(F.col("doc_id") % 7 != 0, F.substring("text", 1, 300)).otherwise(" ")
    return _docs(spark, sf_dir).select("doc_id", t.markdown_cell(value).alias("cell"))


@query("SELECT event_id, format('{:02d}:{:02d}:{:02d}', CAST(floor(value * 100) AS BIGINT) // 3600, CAST(floor(value * 100) AS BIGINT) // 60 % 60, CAST(floor(value * 100) AS BIGINT) % 60) AS clock FROM events")
def f37_clock(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", t.clock(F.col("value") * 100).alias("clock"))


@query("SELECT doc_id, least(21600.0, 600.0 + 120 * (n_chars * 5000) / 1048576.0)::DOUBLE AS seconds FROM documents")
def f38_read_deadline(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.read_deadline(F.col("n_chars") * 5000).cast("double").alias("seconds"))


_MARKERS = {"THE": ["THE "], "DER": ["DER ", "DIE "], "DE": ["DE LA", " QUE "]}


def _place(marker: str) -> str:
    """Where a marker first stands as whole words in h, else null: a letter or digit on one side of each of its ends only."""
    word, none = "[\\p{L}\\p{N}_]", "[^\\p{L}\\p{N}_]"
    before = f"(|.*?{none})" if marker[0].isalnum() else f"(.*?{word})"
    after = f"(?:{none}|$)" if marker[-1].isalnum() else word
    return f"CASE WHEN regexp_matches(h, '(?s)^{before}{marker}{after}') THEN length(regexp_extract(h, '(?s)^{before}{marker}{after}', 1)) + 1 END"


_PLACES = ", ".join(f"({_place(m)}, {k}, '{name}')" for k, (name, m) in enumerate((n, m) for n, ms in _MARKERS.items() for m in ms))


@query(f"""WITH h AS (SELECT doc_id, upper(substr(text, 1, 200)) AS h FROM documents), p AS (SELECT doc_id, [{_PLACES}] AS c FROM h),
u AS (SELECT doc_id, unnest(c) AS x FROM p) SELECT doc_id, arg_min(x[3], x[1] * 10 + x[2]) FILTER (x[1] IS NOT NULL) AS type FROM u GROUP BY doc_id""")
def f16_first_marker(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.first_marker(F.col("text"), _MARKERS).alias("type"))


_DATED = "('ref ' || CASE doc_id % 6 WHEN 0 THEN '31/02/2020 e 5.6.2021' WHEN 1 THEN '7/8/2019' WHEN 2 THEN '3º de março de 2018' WHEN 3 THEN '2020-13-01 2020-12-01' WHEN 4 THEN '2017-03-09' ELSE 'sem data' END || '.')"


@query(f"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '2021-06-05' WHEN 1 THEN '2019-08-07' WHEN 2 THEN '2018-03-03' WHEN 4 THEN '2017-03-09' END AS found, length({_DATED}) AS chars FROM documents""")
def f19_first_date(spark, sf_dir):
    choice = F.element_at(F.array(*map(F.lit, ["31/02/2020 e 5.6.2021", "7/8/2019", "3º de março de 2018", "2020-13-01 2020-12-01", "2017-03-09", "sem data"])), (F.col("doc_id") % 6 + 1).cast("int"))
    text = F.concat(F.lit("ref "), choice, F.lit("."))
    return _docs(spark, sf_dir).select("doc_id", dates.first_date(text).alias("found"), F.length(text).alias("chars"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS same FROM supplier""")
def f27_author_matches(spark, sf_dir):
    k = F.col("s_suppkey") % 4
    expected = F.when(k == 0, "Maria de Souza").when(k == 1, "Procuradoria Geral (PGM)").when(k == 2, "João Li").otherwise("Ana Castro")
    actual = F.when(k == 0, "M. SOUZA").when(k == 1, "pgm/rj").when(k == 2, "Li").otherwise("Ana Castrol")
    return table(spark, sf_dir, "supplier").select("s_suppkey", t.author_matches(expected, actual).alias("same"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'urn:lex:br:federal:lei.complementar:2015-07-06;13' || p_partkey WHEN p_partkey % 3 = 1 THEN 'search:Lei Complementar 13.' || p_partkey ELSE 'search:13.' || p_partkey END AS url FROM part")
def f25_norm_url(spark, sf_dir):
    k = F.col("p_partkey")
    kind, date = F.when(k % 3 != 2, "Lei Complementar"), F.when(k % 3 == 0, "2015-07-06").otherwise("2015-07")
    return table(spark, sf_dir, "part").select("p_partkey", t.norm_url(kind, F.concat(F.lit("13."), k.cast("string")), date).alias("url"))


@query("SELECT doc_id, list_filter(list_transform(string_split(lang || ', ' || source || ', ', ','), lambda x: trim(x)), lambda x: x <> '') AS names, lang || ', ' || source AS field FROM documents")
def f34_files_field(spark, sf_dir):
    raw = F.concat("lang", F.lit(", "), "source", F.lit(", "))
    names = F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")
    return _docs(spark, sf_dir).select("doc_id", names.alias("names"), F.array_join(names, ", ").alias("field"))


@query("SELECT doc_id, list_transform(string_split('1-3,7:eng|4-' || (doc_id % 5 + 4) || ':deu', '|'), lambda x: split_part(x, ':', 2) || '=' || split_part(x, ':', 1)) AS plan FROM documents")
def f36_ocr_plan(spark, sf_dir):
    text = F.concat(F.lit("1-3,7:eng|4-"), F.col("doc_id") % 5 + 4, F.lit(":deu"))
    plan = F.transform(F.split(text, r"\|"), lambda x: F.concat_ws("=", F.split(x, ":")[1], F.split(x, ":")[0]))
    return _docs(spark, sf_dir).select("doc_id", plan.alias("plan"))


# --- predicates and projections --------------------------------------------------------------


@query("SELECT doc_id, md5(substr(text, 1, CASE WHEN doc_id % 2 = 0 THEN 2000 ELSE 4000 END)) AS capped FROM documents")
def p1_page_cap(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(t.page_cap(F.col("text"), F.col("doc_id") % 2 == 0)).alias("capped"))


@query("SELECT doc_id, md5(regexp_replace('~~' || replace(text, '. ', '.~~ ~~'), '~~[^\\n]*?~~', '', 'g')) AS kept FROM documents")
def p4_without_struck(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(t.without_struck(F.concat(F.lit("~~"), F.replace("text", F.lit(". "), F.lit(".~~ ~~"))))).alias("kept"))


_TYPES = "[' ata  de  reunião ', 'null', NULL, 'N/A', 'Índice', '-', '', 'parecer']"


@query(f"WITH v AS (SELECT doc_id, {_TYPES}[doc_id % 8 + 1] AS v FROM documents) SELECT doc_id, CASE WHEN upper(trim(regexp_replace(v, '\\s+', ' ', 'g'))) NOT IN ('', 'NULL', 'N/A', '-') THEN upper(trim(regexp_replace(v, '\\s+', ' ', 'g'))) END AS type FROM v")
def p13_normal_type(spark, sf_dir):
    values = F.array(*[F.lit(x) for x in (" ata  de  reunião ", "null", None, "N/A", "Índice", "-", "", "parecer")])
    return _docs(spark, sf_dir).select("doc_id", t.normal_type(F.get(values, (F.col("doc_id") % 8).cast("int"))).alias("type"))


_DATES = "['2021-09-31', '2021-09-30', '2021-13-05', '2021-13', '2020-01', '1999', '31/12/2020', NULL, '2020-1-1']"
_NORMAL = "['2021-09', '2021-09-30', '2021', '2021', '2020-01', '1999', NULL, NULL, NULL]"


@query(f"SELECT doc_id, {_NORMAL}[doc_id % 9 + 1] AS date, {_DATES}[doc_id % 9 + 1] AS raw FROM documents")
def p14_normal_date(spark, sf_dir):
    raw = F.get(F.array(*[F.lit(x) for x in ("2021-09-31", "2021-09-30", "2021-13-05", "2021-13", "2020-01", "1999", "31/12/2020", None, "2020-1-1")]), (F.col("doc_id") % 9).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", t.normal_date(raw).alias("date"), raw.alias("raw"))


@query("SELECT doc_id, [NULL, NULL, 'J. Silva', NULL, ' ok '][doc_id % 5 + 1] AS author FROM documents")
def p16_placeholders(spark, sf_dir):
    raw = F.get(F.array(*[F.lit(x) for x in ("N.A.", " desconhecido ", "J. Silva", "  ", " ok ")]), (F.col("doc_id") % 5).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", t.without_placeholder(raw).alias("author"))


@query("SELECT doc_id, [true, false, true, false][doc_id % 4 + 1] AS citation FROM documents")
def p10_norm_citation(spark, sf_dir):
    raw = F.get(F.array(*[F.lit(x) for x in ("Lei nº 9.394/1996", "Maria Leite 3", "Resolução CNE 12", "leis 12")]), (F.col("doc_id") % 4).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", t.is_norm_citation(raw).alias("citation"))


@query(f"""WITH {ITEMS_SQL}, {SIZES_SQL}, b AS (SELECT line, CASE WHEN line % 31 = 0 THEN '' ELSE group_key END AS group_key, start_order, CASE WHEN line % 17 = 0 THEN start_order - 2 ELSE end_order END AS end_order, CASE WHEN line % 13 = 0 THEN '2020-02-30' ELSE date END AS date, CASE WHEN line % 11 = 0 THEN 'sure' ELSE confidence END AS confidence FROM items)
SELECT line, list_filter([CASE WHEN group_key = '' THEN 'no group' END, CASE WHEN start_order > end_order THEN 'order is inverted' END, CASE WHEN date = '2020-02-30' THEN 'date is not canonical' END, CASE WHEN confidence = 'sure' THEN 'unknown confidence' END,
    CASE WHEN start_order < 1 OR end_order > coalesce(pages, 0) THEN 'outside the group' END], lambda x: x IS NOT NULL) AS problems FROM b LEFT JOIN sizes USING (group_key)""")
def p11_validation(spark, sf_dir):
    k = F.col("line")
    bad = collection.items(spark, sf_dir).select(
        "line", F.when(k % 31 == 0, "").otherwise(F.col("group_key")).alias("group_key"), "start_order", F.when(k % 17 == 0, F.col("start_order") - 2).otherwise(F.col("end_order")).alias("end_order"),
        F.when(k % 13 == 0, "2020-02-30").otherwise(F.col("date")).alias("date"), F.when(k % 11 == 0, "sure").otherwise(F.col("confidence")).alias("confidence"),
    )
    return pieces.problems(bad, collection.group_sizes(spark, sf_dir)).select("line", "problems")


@query(f"WITH {PAGES_SQL} SELECT file_id, number, 'p. ' || number AS library, 'f. ' || row_number() OVER (PARTITION BY group_key ORDER BY file_id, number) AS running FROM pages_")
def p18_references(spark, sf_dir):
    from ..operators import ordered

    rows = ordered.positions(collection.pages(spark, sf_dir), ["group_key"], ["file_id", "number"])
    return rows.select("file_id", "number", F.concat(F.lit("p. "), "number").alias("library"), F.concat(F.lit("f. "), "pos").alias("running"))


# --- sets and sorts --------------------------------------------------------------------------


@query("SELECT user_id, bool_and(event_type IN ('error', 'view')) AS only_fallback FROM events GROUP BY user_id")
def u2_fallback_only(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_and(F.col("event_type").isin("error", "view")).alias("only_fallback"))


@query("SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def u3_stored_not_derived(spark, sf_dir):
    derived = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_custkey")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).subtract(derived)


@query("""WITH w AS (SELECT item_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM w WHERE len(w) >= 3 UNION ALL SELECT item_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 2)
SELECT item_id, count(*) AS trigrams FROM g GROUP BY item_id""")
def u6_word_trigrams(spark, sf_dir):
    w = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(t.word_ngrams(w, 3)).cast("long").alias("trigrams")).filter("trigrams > 0")


_GRAMS_SQL = """dw AS (SELECT doc_id AS id, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id AS id, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM benchmark),
dg AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM dw WHERE len(w) >= 3),
bg AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM bw WHERE len(w) >= 3)"""


@query(f"WITH {_GRAMS_SQL} SELECT id AS doc_id, count(bg.g) / CAST(count(*) AS DOUBLE) AS share FROM dg LEFT JOIN bg USING (g) GROUP BY id")
def u5_ngram_containment(spark, sf_dir):
    tokens = lambda df: t.settled(df, w=F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != ""))
    grams = lambda df: tokens(df).filter(F.size("w") >= 3).select("*", F.explode(t.word_ngrams(F.col("w"), 3)).alias("g"))
    docs = grams(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "g")
    ref = grams(table(spark, sf_dir, "benchmark")).select("g").distinct().withColumn("hit", F.lit(1))
    return docs.join(ref, "g", "left").groupBy("doc_id").agg((F.count("hit") / F.count("*")).alias("share"))


@query(f"WITH {FILES_SQL} SELECT file_id, row_number() OVER (ORDER BY split_part(relative_path, '/', 1)[1:3], CAST(regexp_extract(relative_path, 'src(\\d+)', 1) AS INT), language, file_id) AS place FROM files")
def o1_natural_sort(spark, sf_dir):
    from ..operators import ordered

    rows = collection.files(spark, sf_dir).select("file_id", F.lit(0).alias("all"), t.natural_key(F.col("relative_path")).alias("key"))
    return ordered.positions(rows, ["all"], ["key"], "place").select("file_id", "place")


@query("SELECT event_id, user_id, ts FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 50")
def o3_last_errors(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", "user_id", "ts").orderBy(F.desc("event_id")).limit(50)


@query("""WITH c AS (SELECT source, lang, sum(n_chars) AS w FROM documents GROUP BY ALL), s AS (SELECT *, w / CAST(sum(w) OVER (PARTITION BY source) AS DOUBLE) AS share, row_number() OVER (PARTITION BY source ORDER BY w DESC, lang) AS r FROM c)
SELECT source, lang, share FROM s WHERE share >= 0.15 AND r <= 3""")
def o5_top_languages(spark, sf_dir):
    c = _docs(spark, sf_dir).groupBy("source", "lang").agg(F.sum("n_chars").alias("w"))
    g = c.groupBy("source").agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), "lang"))).alias("l"), F.sum("w").alias("total"))
    top = g.select("source", "total", F.explode(F.slice("l", 1, 3)).alias("x"))
    return top.select("source", "x.lang", (-F.col("x.w") / F.col("total")).alias("share")).filter("share >= 0.15")


# --- search ----------------------------------------------------------------------------------


@query("""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM documents WHERE lang = 'en')
SELECT doc_id, term, count(*) AS tf FROM t WHERE regexp_full_match(term, '[a-z]+') GROUP BY ALL""")
def x1_postings(spark, sf_dir):
    rows = search.postings(_docs(spark, sf_dir).filter("lang = 'en'"), ["doc_id"])
    return rows.filter(F.col("term").rlike("^[a-z]+$")).select("doc_id", "term", "tf")


_TOKENS_SQL = "t AS (SELECT item_id, list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t)"


@query(f"""WITH {_TOKENS_SQL}, c AS (SELECT item_id, len(w) AS dl, CAST(len(list_filter(w, lambda x: x = 'the')) AS DOUBLE) AS t0, CAST(len(list_filter(w, lambda x: starts_with(x, 'th'))) AS DOUBLE) AS t1 FROM t),
d AS (SELECT count(*) FILTER (t0 > 0) AS n0, count(*) FILTER (t1 > 0) AS n1 FROM c), i AS (SELECT CASE WHEN ln((n - n0 + 0.5) / (n0 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n0 + 0.5) / (n0 + 0.5)) END AS i0, CASE WHEN ln((n - n1 + 0.5) / (n1 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n1 + 0.5) / (n1 + 0.5)) END AS i1, a FROM d, s)
SELECT item_id, round(i0 * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * dl / a)) + i1 * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / a)), 9) AS score FROM c, i WHERE t0 > 0 AND t1 > 0""")
def x3_bm25_search(spark, sf_dir):
    """Every term must occur; ranked by BM25. Terms: a word and a prefix."""
    return search.search(table(spark, sf_dir, "benchmark"), "the th*", ["item_id"]).withColumn("score", F.round("score", 9))


_INDEXED_SQL = """SELECT item_id, round(CASE WHEN ln((n - n0 + 0.5) / (n0 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n0 + 0.5) / (n0 + 0.5)) END * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * dl / a)), 9) AS score FROM c, d, s WHERE t0 > 0"""


def _indexed(spark, sf_dir, words):
    items = table(spark, sf_dir, "benchmark")
    path = f"{ordered.shared_folder(items)}/index-{uuid.uuid4().hex}"
    search.build_index(items, ["item_id"], path)
    return search.search_index(spark, path, words, ["item_id"]).withColumn("score", F.round("score", 9))


@query(f"""WITH {_TOKENS_SQL}, q AS (SELECT w[1] AS a1, w[2] AS a2 FROM t ORDER BY item_id LIMIT 1),
c AS (SELECT item_id, len(w) AS dl, CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = a1 AND w[i + 1] = a2)) AS DOUBLE) AS t0 FROM t, q), d AS (SELECT count(*) FILTER (t0 > 0) AS n0 FROM c) {_INDEXED_SQL}""")
def x3_phrase_search(spark, sf_dir):
    """The first two words of the first item as a phrase, through an index."""
    words = table(spark, sf_dir, "benchmark").orderBy("item_id").select(t.words(F.col("text"))).first()[0]
    return _indexed(spark, sf_dir, f'"{words[0]} {words[1]}"')


@query(f"""WITH {_TOKENS_SQL}, q AS (SELECT substr(w[1], 1, 2) AS p FROM t ORDER BY item_id LIMIT 1),
c AS (SELECT item_id, len(w) AS dl, CAST(len(list_filter(w, lambda x: starts_with(x, p))) AS DOUBLE) AS t0 FROM t, q), d AS (SELECT count(*) FILTER (t0 > 0) AS n0 FROM c) {_INDEXED_SQL}""")
def x3_prefix_index_search(spark, sf_dir):
    """The first two letters of the first item as a prefix, through an index."""
    words = table(spark, sf_dir, "benchmark").orderBy("item_id").select(t.words(F.col("text"))).first()[0]
    return _indexed(spark, sf_dir, f"{words[0][:2]}*")


@query("""WITH f AS (SELECT item_id, regexp_replace(lower(text), '\\s+', '', 'g') AS t FROM benchmark) SELECT item_id, len(list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)))) AS grams, contains(t, 'ofthe') AS hit FROM f""")
def x4_unspaced_trigrams(spark, sf_dir):
    flat = F.regexp_replace(F.lower("text"), r"\s+", "")
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(search.char_trigrams(F.col("text"))).cast("long").alias("grams"), flat.contains("ofthe").alias("hit"))


@query()
def w20_passages(spark, sf_dir):
    """Passages of the whole documents; a fold with two thresholds, checked against a loop in the tests."""
    return search.passages(_docs(spark, sf_dir))


@query("SELECT item_id, substr(text, greatest(instr(lower(text), 'that') - 80, 1), instr(lower(text), 'that') - greatest(instr(lower(text), 'that') - 80, 1) + 84) AS snippet FROM benchmark WHERE instr(lower(text), 'that') > 0")
def f14_snippet(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", search.snippet(F.col("text"), "that").alias("snippet")).filter("snippet is not null")

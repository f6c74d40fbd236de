"""Queries over whole texts and all rows, beside those whose SQL is bound to a part of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import search
from ..sources import collection
from ..sources.collection import ITEMS_SQL, table
from .piece_queries import _key_and_rest
from .registry import query


@query("""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM documents)
SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL""")
def x1_postings_all(spark, sf_dir):
    """Every term of every document, in any language."""
    return search.postings(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "term", "tf")


@query("SELECT doc_id, md5(upper(translate(text, 'áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑß', 'aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN'))) AS plain FROM documents")
def f3_upper_fold_whole(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.upper(t.fold(F.replace("text", F.lit("ß"), F.lit(""))))).alias("plain"))


@query("SELECT doc_id, coalesce(nullif(trim(replace(regexp_replace(text, '\\s*\\n\\s*', ' ', 'g'), '|', '\\|')), ''), '—') AS cell FROM documents")
def f33_markdown_cell_whole(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.markdown_cell(F.col("text")).alias("cell"))


@query(f"""WITH {ITEMS_SQL}, d AS (SELECT DISTINCT group_key, end_order AS pos FROM items), i AS (SELECT DISTINCT group_key, start_order, end_order FROM items)
SELECT i.group_key, start_order, end_order, count(d.pos) AS ends_inside FROM i LEFT JOIN d ON d.group_key = i.group_key AND d.pos BETWEEN start_order AND end_order GROUP BY ALL""")
def j11_interval_containment_all(spark, sf_dir):
    """All pieces and their own intervals."""
    items = collection.items(spark, sf_dir)
    spots = items.select("group_key", "start_order", "end_order").distinct().select("*", F.explode(F.sequence("start_order", "end_order")).alias("pos"))
    ends = items.select("group_key", F.col("end_order").alias("pos")).distinct().withColumn("hit", F.lit(1))
    return spots.join(ends, ["group_key", "pos"], "left").groupBy("group_key", "start_order", "end_order").agg(F.count("hit").alias("ends_inside"))


@query(f"""WITH {ITEMS_SQL}, one AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY line ORDER BY group_key, start_order, end_order) = 1),
k AS (SELECT line AS key_id, group_key, start_order AS a, end_order + 1 AS b FROM one WHERE line % 9 = 0), x AS (SELECT line AS index_id, group_key, start_order AS c, end_order AS d FROM one WHERE line % 9 <> 0),
n AS (SELECT key_id, index_id, least(b, d) - greatest(a, c) + 1 AS n, b - a + 1 + d - c + 1 AS both_ FROM k JOIN x USING (group_key) WHERE least(b, d) >= greatest(a, c)) SELECT key_id, index_id, n / CAST(both_ - n AS DOUBLE) AS score FROM n""")
def j14_jaccard_pairs_all(spark, sf_dir):
    """One ninth of the pieces as key, all others as index."""
    key, index = _key_and_rest(spark, sf_dir)
    spot = lambda df, n: df.select(F.col("id").alias(n), "group_key", F.explode(F.sequence("start_order", "end_order")).alias("pos"), (F.col("end_order") - F.col("start_order") + 1).alias(f"{n}_n"))
    both = spot(key, "key_id").join(spot(index, "index_id"), ["group_key", "pos"]).groupBy("key_id", "index_id", "key_id_n", "index_id_n").agg(F.count("*").alias("n"))
    return both.select("key_id", "index_id", (F.col("n") / (F.col("key_id_n") + F.col("index_id_n") - F.col("n"))).alias("score"))


@query(f"""WITH {ITEMS_SQL}, k AS (SELECT group_key, start_order, type, date FROM items WHERE line % 9 = 0), m AS (SELECT i.confidence, i.type AS t1, k.type AS t2, i.date AS d1, k.date AS d2 FROM items i JOIN k USING (group_key, start_order) WHERE line % 9 <> 0)
SELECT confidence, count(*) AS matched, count(*) FILTER (coalesce(t1, '') = coalesce(t2, '')) AS type_hits, count(d2) AS dated, count(*) FILTER (d1 = d2) AS date_hits FROM m GROUP BY confidence""")
def a30_accuracy_by_confidence_all(spark, sf_dir):
    items = collection.items(spark, sf_dir)
    key = items.filter(F.col("line") % 9 == 0).select("group_key", "start_order", F.col("type").alias("t2"), F.col("date").alias("d2"))
    m = items.filter(F.col("line") % 9 != 0).join(key, ["group_key", "start_order"])
    blank = lambda c: F.coalesce(c, F.lit(""))
    return m.groupBy("confidence").agg(F.count("*").alias("matched"), F.count_if(blank("type") == blank("t2")).alias("type_hits"), F.count("d2").alias("dated"), F.count_if(F.col("date") == F.col("d2")).alias("date_hits"))

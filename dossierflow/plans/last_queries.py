"""Queries on folds, pruned scans, item lines, coverage fill and engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import engines, pieces
from ..sources import collection
from ..sources.collection import FILES_SQL, ITEMS_SQL, PAGES_SQL, SIZES_SQL, table
from .engine_queries import _window_pages
from .registry import query


@query("SELECT doc_id, md5(upper(translate(substr(text, 1, 500), 'áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑß', 'aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN'))) AS plain FROM documents")
def f3_upper_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.upper(t.fold(F.replace(F.substring("text", 1, 500), F.lit("ß"), F.lit(""))))).alias("plain"))


@query("SELECT item_id, trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '\\d[\\d.,]*\\d|\\d', '#', 'g'), '[^\\p{L}\\p{N}_#]+', ' ', 'g')) AS normal FROM benchmark")
def f4_comparable_text(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", t.comparable(F.col("text")).alias("normal"))


@query("SELECT doc_id, length(text) AS chars, true AS same_length FROM documents")
def f5_length_preserving_fold(spark, sf_dir):
    folded = F.length(t.fold(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", folded.alias("chars"), (folded == F.length("text")).alias("same_length"))


@query("SELECT doc_id, CASE lang WHEN 'de' THEN 'deu' WHEN 'en' THEN 'eng' WHEN 'es' THEN 'spa' WHEN 'fr' THEN 'fra' END AS model FROM documents")
def f10_ocr_model(spark, sf_dir):
    models = F.create_map(*[F.lit(x) for x in ("de", "deu", "en", "eng", "es", "spa", "fr", "fra", "pt", "por", "ja", "jpn", "ko", "kor", "zh", "chi_sim")])
    return table(spark, sf_dir, "documents").select("doc_id", F.try_element_at(models, F.col("lang")).alias("model"))


@query(f"WITH {PAGES_SQL} SELECT group_key, file_id, number FROM pages_")
def p5_pages_without_text(spark, sf_dir):
    """The text column is never read: the scan's schema has the ids only."""
    return collection.pages(spark, sf_dir).select("group_key", "file_id", "number")


@query(f"WITH {ITEMS_SQL} SELECT line, group_key || '|' || start_order || '|' || end_order || '|' || coalesce(type, '') || '|' || coalesce(date, '') || '|' || confidence AS row FROM items")
def p19_item_row(spark, sf_dir):
    blank = lambda c: F.coalesce(c, F.lit(""))
    row = F.concat_ws("|", "group_key", "start_order", "end_order", blank(t.normal_type(F.col("type"))), blank(t.normal_date(F.col("date"))), t.normal_confidence(F.col("confidence")))
    return collection.items(spark, sf_dir).select("line", row.alias("row"))


@query(f"WITH {FILES_SQL}, r AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) SELECT file_id, file_id IN (SELECT doc_id FROM r) OR extension = 'html' AS norm FROM files")
def p22_norm_files(spark, sf_dir):
    known = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("file_id")).distinct().withColumn("known", F.lit(True))
    return collection.files(spark, sf_dir).join(known, "file_id", "left").select("file_id", (F.coalesce("known", F.lit(False)) | (F.col("extension") == "html")).alias("norm"))


@query(f"""WITH {ITEMS_SQL}, {SIZES_SQL}, m AS (SELECT group_key, unnest(range(1, pages + 1)) AS pos FROM sizes EXCEPT SELECT group_key, unnest(range(start_order, end_order + 1)) FROM items),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY group_key ORDER BY pos) AS k FROM m), g AS (SELECT group_key, min(pos) AS start_order, max(pos) AS end_order, 'low' AS confidence FROM r GROUP BY group_key, k)
SELECT group_key, start_order, end_order, confidence FROM items UNION ALL SELECT group_key, start_order, end_order, confidence FROM g""")
def x22_coverage_fill(spark, sf_dir):
    """Sound pieces, and a low piece for each run of pages that none of them covers."""
    items, sizes = collection.items(spark, sf_dir), collection.group_sizes(spark, sf_dir)
    fill = pieces.gaps(items, sizes).select("group_key", F.col("first").alias("start_order"), F.col("last").alias("end_order"), F.lit("low").alias("confidence"))
    return items.select("group_key", "start_order", "end_order", "confidence").unionByName(fill)


class _ByFile:
    """An engine for the query below: one piece for each run of pages of a file."""

    def classify(self, pages: list[dict]) -> list[dict]:
        out: list[dict] = []
        for page in pages:
            if out and out[-1]["type"] == page["file"]:
                out[-1]["end_order"] = page["pos"]
            else:
                out.append({"start_order": page["pos"], "end_order": page["pos"], "type": page["file"], "date": None, "summary": None, "confidence": "medium"})
        return out


@query(f"""WITH {PAGES_SQL}, p AS (SELECT group_key, path, row_number() OVER (PARTITION BY group_key ORDER BY file_id, number) AS pos FROM pages_), sizes AS (SELECT group_key, count(*) AS pages FROM pages_ GROUP BY group_key),
spans AS (SELECT group_key, s + 1 AS start_pos, least(s + 16, pages) AS end_pos FROM (SELECT group_key, pages, unnest(range(0, CAST(greatest(0, ceil((pages - 16) / 14.0)) AS BIGINT) * 14 + 1, 14)) AS s FROM sizes))
SELECT s.group_key, s.start_pos, min(p.pos) AS start_order, max(p.pos) AS end_order, path AS type FROM spans s JOIN p ON s.group_key = p.group_key AND p.pos BETWEEN s.start_pos AND s.end_pos GROUP BY s.group_key, s.start_pos, path""")
def x6_engine_protocol(spark, sf_dir):
    """Any engine runs over windows; this one starts a piece at each new file."""
    return engines.run(_window_pages(spark, sf_dir), _ByFile()).select("group_key", "start_pos", "start_order", "end_order", "type")

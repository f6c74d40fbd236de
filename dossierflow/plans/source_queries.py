"""Queries on sources, scans and admission (S), and on readers that SQL can follow (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import admission, collection, readers
from ..sources.collection import FILES_SQL, table
from .registry import query

_NAMES = "['exe','zip','mp3','pem','gdoc','pages','pdf','txt']"
_NAME_SQL = f"names AS (SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN '~$lock' || doc_id || '.docx' WHEN 1 THEN 'Desktop.ini' WHEN 2 THEN 'id_rsa_' || doc_id ELSE 'Doc' || doc_id || '.' || {_NAMES}[doc_id % 8 + 1] END AS name FROM documents)"


def _names(spark, sf_dir):
    exts = F.array(*[F.lit(x) for x in ("exe", "zip", "mp3", "pem", "gdoc", "pages", "pdf", "txt")])
    k = F.col("doc_id")
    name = F.when(k % 11 == 0, F.concat(F.lit("~$lock"), k, F.lit(".docx"))).when(k % 11 == 1, "Desktop.ini").when(k % 11 == 2, F.concat(F.lit("id_rsa_"), k))
    return table(spark, sf_dir, "documents").select("doc_id", name.otherwise(F.concat(F.lit("Doc"), k, F.lit("."), F.element_at(exts, (k % 8 + 1).cast("int")))).alias("name"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def s3_content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query(f"""WITH {_NAME_SQL}, e AS (SELECT *, lower(name) AS low, regexp_extract(lower(name), '[^/.]\\.([^./]+)$', 1) AS ext FROM names)
SELECT doc_id, name, CASE WHEN low = 'desktop.ini' OR starts_with(low, '~$') THEN 'system' WHEN ext = 'gdoc' THEN 'google_doc' WHEN ext = 'zip' THEN 'archive'
    WHEN ext = 'exe' THEN 'blocked_extension' WHEN ext = 'mp3' THEN 'media_not_selected' WHEN ext = 'pem' OR starts_with(low, 'id_rsa') THEN 'secret' WHEN ext = 'pages' THEN 'unsupported' END AS reason FROM e""")
def s5_name_decision(spark, sf_dir):
    return _names(spark, sf_dir).withColumn("reason", admission.name_decision(F.col("name")))


@query("""WITH t AS (SELECT doc_id, substr(repeat(chr(1), CAST(doc_id % 60 AS INTEGER)) || repeat('a', 100), 1, 100) AS t FROM documents)
SELECT doc_id, length(regexp_replace(t, '[^\\x01]', '', 'g')) > 30 AS is_binary FROM t""")
def s7_binary_sniff(spark, sf_dir):
    """A hundred bytes of which up to sixty are controls: binary from the thirty-first on."""
    head = F.substring(F.concat(F.repeat(F.lit("\x01"), (F.col("doc_id") % 60).cast("int")), F.repeat(F.lit("a"), 100)), 1, 100)
    return table(spark, sf_dir, "documents").select("doc_id", admission.looks_binary(head.cast("binary")).alias("is_binary"))


@query("""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || '-----BEGIN RSA PRIVATE KEY-----' WHEN doc_id % 10 = 1 THEN 'PRIVATE KEY-----' || text || '-----BEGIN' ELSE text END AS text FROM documents)
SELECT doc_id, contains(text, '-----BEGIN') AND contains(substr(text, instr(text, '-----BEGIN')), 'PRIVATE KEY-----') AS secret FROM t""")
def s8_private_key(spark, sf_dir):
    k = F.col("doc_id") % 10
    text = F.when(k == 0, F.concat("text", F.lit("-----BEGIN RSA PRIVATE KEY-----"))).when(k == 1, F.concat(F.lit("PRIVATE KEY-----"), "text", F.lit("-----BEGIN"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", admission.has_private_key(text.cast("binary")).alias("secret"))


@query(f"""WITH {FILES_SQL} SELECT file_id, CASE extension WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'txt' THEN 'text' WHEN 'md' THEN 'text' WHEN 'html' THEN 'web_data'
    WHEN 'mp3' THEN 'media' WHEN 'eml' THEN 'email' END AS category FROM files""")
def s11_extension_category(spark, sf_dir):
    return collection.files(spark, sf_dir).select("file_id", admission.category(F.col("extension")).alias("category"))


@query(f"""WITH {FILES_SQL} SELECT file_id, 'all' AS by_all, split_part(relative_path, '/', 1) AS by_folder, nullif(regexp_extract(relative_path, 'src(1[0-9])', 1), '') AS by_pattern FROM files""")
def s12_group_key(spark, sf_dir):
    path = F.col("relative_path")
    return collection.files(spark, sf_dir).select(
        "file_id", admission.group_key(path, "all_together").alias("by_all"), admission.group_key(path, "subfolder").alias("by_folder"),
        admission.group_key(path, "regex", "src(1[0-9])").alias("by_pattern"),
    )


_SNAPSHOT = """old AS (SELECT relative_path, size, CAST(file_id % 3 AS DOUBLE) AS mtime, sha256 FROM files WHERE file_id % 10 <> 0),
new AS (SELECT CASE WHEN file_id % 17 = 0 THEN 'moved/' || relative_path ELSE relative_path END AS relative_path, CASE WHEN file_id % 13 = 0 THEN size + 1 ELSE size END AS size,
    CASE WHEN file_id % 7 = 0 THEN 9.0 ELSE CAST(file_id % 3 AS DOUBLE) END AS mtime, CASE WHEN file_id % 13 = 0 THEN sha256(text || 'x') ELSE sha256 END AS sha256 FROM files WHERE file_id % 11 <> 0)"""


def _snapshots(spark, sf_dir):
    files = collection.files(spark, sf_dir).withColumn("mtime", (F.col("file_id") % 3).cast("double"))
    k = F.col("file_id")
    old = files.filter(k % 10 != 0).select("relative_path", "size", "mtime", "sha256")
    new = files.filter(k % 11 != 0).select(
        F.when(k % 17 == 0, F.concat(F.lit("moved/"), "relative_path")).otherwise(F.col("relative_path")).alias("relative_path"),
        F.when(k % 13 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(k % 7 == 0, 9.0).otherwise(F.col("mtime")).alias("mtime"),
        F.when(k % 13 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.col("sha256")).alias("sha256"),
    )
    return old, new


@query(f"""WITH {FILES_SQL}, {_SNAPSHOT}, j AS (
    SELECT coalesce(n.relative_path, o.relative_path) AS relative_path, n.sha256, CASE WHEN n.relative_path IS NULL THEN 'removed' WHEN o.relative_path IS NULL THEN 'new'
        WHEN n.size = o.size AND n.mtime = o.mtime THEN 'unchanged' WHEN n.sha256 = o.sha256 THEN 'touched' ELSE 'changed' END AS status
    FROM new n FULL JOIN old o ON n.relative_path = o.relative_path)
SELECT relative_path, CASE WHEN status = 'new' AND (sha256 IN (SELECT sha256 FROM old) OR row_number() OVER (PARTITION BY status, sha256 ORDER BY lower(relative_path), relative_path) > 1) THEN 'duplicate' ELSE status END AS status FROM j""")
def s13_inventory_scan(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return admission.inventory(new, old)


@query(f"""WITH {FILES_SQL} SELECT file_id, first_value(relative_path) OVER w AS original, CASE WHEN row_number() OVER w = 1 THEN 'discovered' ELSE 'duplicate' END AS status
FROM files WINDOW w AS (PARTITION BY sha256 ORDER BY lower(relative_path), relative_path)""")
def s14_exact_dedup(spark, sf_dir):
    return admission.exact_copies(collection.files(spark, sf_dir)).select("file_id", "original", "status")


@query(f"""WITH {FILES_SQL}, {_SNAPSHOT}, lost AS (SELECT o.sha256 FROM old o LEFT JOIN new n ON n.relative_path = o.relative_path WHERE n.sha256 IS DISTINCT FROM o.sha256)
SELECT DISTINCT sha256 FROM lost WHERE sha256 NOT IN (SELECT sha256 FROM new)""")
def s15_released_contents(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return old.select("sha256").distinct().join(new, "sha256", "left_anti")


@query("""WITH e AS (SELECT c_custkey % 20 AS id, c_custkey AS created_at, c_name AS name FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at, name) AS r FROM e)
SELECT created_at, name, CASE WHEN r = 1 THEN id ELSE (SELECT max(id) FROM e) + row_number() OVER (PARTITION BY r > 1 ORDER BY created_at, name, id) END AS id FROM r""")
def s16_catalog_ids(spark, sf_dir):
    entries = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 20).alias("id"), F.col("c_custkey").alias("created_at"), F.col("c_name").alias("name"))
    return admission.unique_ids(entries).select("created_at", "name", "id")


@query("""WITH s AS (SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z]+', '-', 'g'), '-') AS slug FROM supplier)
SELECT s_suppkey, CASE WHEN row_number() OVER w = 1 THEN slug ELSE slug || '-' || row_number() OVER w END AS alias FROM s WINDOW w AS (PARTITION BY slug ORDER BY s_suppkey)""")
def s17_unique_aliases(spark, sf_dir):
    from ..operators import ordered

    slugs = table(spark, sf_dir, "supplier").select("s_suppkey", F.btrim(F.regexp_replace(F.lower("s_name"), "[^a-z]+", "-"), F.lit("-")).alias("slug"))
    ranked = ordered.positions(slugs, ["slug"], ["s_suppkey"], "r")
    return ranked.select("s_suppkey", F.when(F.col("r") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", "r")).alias("alias"))


@query(f"""WITH {_NAME_SQL}, e AS (SELECT lower(name) AS low, regexp_extract(lower(name), '[^/.]\\.([^./]+)$', 1) AS ext FROM names), r AS (
    SELECT CASE WHEN low = 'desktop.ini' OR starts_with(low, '~$') THEN 'system' WHEN ext = 'gdoc' THEN 'google_doc' WHEN ext = 'zip' THEN 'archive' WHEN ext = 'exe' THEN 'blocked_extension'
        WHEN ext = 'mp3' THEN 'media_not_selected' WHEN ext = 'pem' OR starts_with(low, 'id_rsa') THEN 'secret' WHEN ext = 'pages' THEN 'unsupported' END AS reason, ext FROM e)
SELECT reason, ext, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason, ext ORDER BY n DESC, reason, ext""")
def s23_ignored_summary(spark, sf_dir):
    names = _names(spark, sf_dir).select(admission.name_decision(F.col("name")).alias("reason"), admission.extension(F.col("name")).alias("ext"))
    return names.filter("reason is not null").groupBy("reason", "ext").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason", "ext")


@query("""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(head|script|style|noscript|template)\\b.*?</(head|script|style|noscript|template)>', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(h, '(?i)</?(p|div|br|li|tr|h[1-6]|ul|ol|table|section|article|header|footer|nav|body|html|title|main)\\b[^>]*>', chr(10), 'g') AS h FROM a),
c AS (SELECT page_id, regexp_replace(h, '<[^>]*>', '', 'g') AS h FROM b),
d AS (SELECT page_id, replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS h FROM c)
SELECT page_id, trim(regexp_replace(regexp_replace(h, '[ \\t\\r]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10)) AS text FROM d""")
def r3_html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", readers.stripped_html(F.col("html")).alias("text"))


@query("""SELECT page_id, regexp_matches(regexp_replace(html, '(?s)^\\s*(<\\?xml.*?\\?>|<!--.*?-->|<!DOCTYPE[^>]*>|\\s)*', '', ''), '(?i)^<html\\b') AS is_html FROM pages""")
def r6_looks_like_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", readers.looks_like_html(F.col("html")).alias("is_html"))


@query("""WITH h AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '25504446' WHEN 1 THEN '504B0304' WHEN 2 THEN '7B5C727466' WHEN 3 THEN 'D0CF11E0' ELSE '' END || hex(encode(text)) AS h FROM documents)
SELECT doc_id, CASE WHEN starts_with(h, '25504446') THEN 'pdf' WHEN starts_with(h, '504B0304') THEN 'zip' WHEN starts_with(h, '7B5C727466') THEN 'rtf' WHEN starts_with(h, 'D0CF11E0') THEN 'ole' ELSE 'text' END AS kind FROM h""")
def r24_sniff_content(spark, sf_dir):
    head = F.element_at(F.array(*map(F.lit, ["25504446", "504B0304", "7B5C727466", "D0CF11E0", ""])), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", readers.content_type(F.concat(F.unhex(head), F.col("text").cast("binary"))).alias("kind"))


@query("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS number, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, number, length(line) AS chars FROM l""")
def r19_page_iterator(spark, sf_dir):
    parts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return parts.select("doc_id", (F.col("p") + 1).alias("number"), F.length("line").alias("chars"))


@query("""WITH c AS (SELECT conv_id, coalesce(nullif(trim(max(text) FILTER (role = 'user' AND turn = 1)), ''), nullif(trim(max(text) FILTER (turn = 0)), '')) AS body FROM conversations GROUP BY conv_id) SELECT conv_id, body FROM c""")
def r41_body_preference(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations")
    chosen = lambda c: F.nullif(F.trim(F.max(F.when(c, F.col("text")))), F.lit(""))
    return talks.groupBy("conv_id").agg(F.coalesce(chosen((F.col("role") == "user") & (F.col("turn") == 1)), chosen(F.col("turn") == 0)).alias("body"))

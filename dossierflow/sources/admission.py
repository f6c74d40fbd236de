"""Which files of a folder enter the collection, as expressions on their names and first bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Extensions by reason, names and prefixes of bookkeeping files.
GOOGLE = ["gdoc", "gsheet", "gslides", "gdraw", "gform", "gmap", "gsite", "gjam"]
ARCHIVES = ["zip", "7z", "rar", "tar", "gz", "tgz", "bz2", "xz", "zst", "cab", "lz", "lzma", "arj", "z"]
BLOCKED = [
    "exe", "dll", "msi", "bat", "cmd", "com", "scr", "sys", "bin", "so", "dylib", "iso", "vhd", "vhdx", "drv", "ocx", "cpl", "vbs", "js", "jar", "apk", "deb", "rpm",
    "ps1", "sh", "app", "lnk", "ini", "img", "dmg", "vmdk", "qcow2", "db", "sqlite", "sqlite3", "mdb", "accdb", "dbf", "ttf", "otf", "woff", "woff2", "dwg", "pyc",
    "pyd", "class", "o", "obj", "lib", "a", "wasm", "msix", "appx",
]
SECRETS = ["pem", "key", "pfx", "p12", "kdbx", "ppk", "jks", "keystore", "env"]
SECRET_PREFIXES = ["id_rsa", "id_ed25519"]
UNSUPPORTED = ["pages"]
SYSTEM_NAMES = ["desktop.ini", "thumbs.db", "ehthumbs.db", ".ds_store", ".dropbox", ".dropbox.attr", "folder.jpg", "albumartsmall.jpg"]
SYSTEM_PREFIXES = ["~$", ".~lock.", "albumart_"]
HEAD_BYTES = 8192
#: Categories of extensions that queries use; paged ones have real pages.
CATEGORIES = {
    "pdf": ["pdf"], "docx": ["docx"], "xlsx": ["xlsx"], "pptx": ["pptx"], "rtf": ["rtf"], "text": ["txt", "md", "csv", "log"], "web_data": ["html", "htm", "xml", "json", "mhtml"],
    "subtitle": ["srt", "vtt"], "email": ["eml", "msg"], "mbox": ["mbox"], "cad": ["dxf"], "image": ["png", "jpg", "jpeg", "tif", "tiff"], "media": ["mp3", "wav", "mp4", "mkv", "ogg"],
}
PAGED = ["pdf", "image"]


def extension(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.rlike(r"^\.[^.]+$"), F.substring(low, F.lit(2), F.length(low))).otherwise(F.regexp_extract(low, r"[^/.]\.([^./]+)$", 1))


def category(ext: Column) -> Column:
    lookup = F.create_map(*[x for c, es in CATEGORIES.items() for e in es for x in (F.lit(e), F.lit(c))])
    return F.try_element_at(lookup, ext)


def name_decision(name: Column, categories: tuple[str, ...] = ()) -> Column:
    """Why a file must not be indexed, by its name; null if the name does not decide."""
    low, ext = F.lower(name), extension(name)
    begins = lambda prefixes: F.coalesce(*[F.when(low.startswith(p), True) for p in prefixes], F.lit(False))
    reason = F.when(low.isin(SYSTEM_NAMES) | begins(SYSTEM_PREFIXES), "system").when(ext.isin(GOOGLE), "google_doc").when(ext.isin(ARCHIVES), "archive").when(ext.isin(BLOCKED), "blocked_extension")
    if "media" not in categories:
        reason = reason.when(ext.isin(CATEGORIES["media"]), "media_not_selected")
    return reason.when(ext.isin(SECRETS) | begins(SECRET_PREFIXES), "secret").when(ext.isin(UNSUPPORTED), "unsupported")


def looks_binary(content: Column) -> Column:
    """First bytes only: a byte order mark means text, a NUL or more than 30 % controls binary."""
    head = F.substring(content, 1, HEAD_BYTES)
    text = F.decode(head, "ISO-8859-1")
    bom = F.hex(head).rlike("^(EFBBBF|FFFE|FEFF|0000FEFF)")
    controls = F.length(F.regexp_replace(text, r"[^\x00-\x08\x0B\x0E-\x1A\x1C-\x1F]", ""))
    return (F.octet_length(head) > 0) & ~bom & (text.contains("\x00") | (controls > 0.3 * F.octet_length(head)))


def has_private_key(content: Column) -> Column:
    """A BEGIN mark with the end mark of a private key somewhere after it."""
    text = F.decode(content, "ISO-8859-1")
    after = F.substring(text, F.instr(text, "-----BEGIN"), F.length(text))
    return text.contains("-----BEGIN") & (after.contains("PRIVATE KEY-----") | after.contains("PRIVATE KEY BLOCK-----"))


def group_key(path: Column, mode: str, pattern: str = "") -> Column:
    """all_together, first path segment, or the regular expression's first group (else its whole match, else null)."""
    if mode == "all_together":
        return F.lit("all")
    if mode == "subfolder":
        return F.when(F.instr(path, "/") > 0, F.split(path, "/")[0]).otherwise(F.lit("all"))
    whole, first = F.regexp_extract(path, pattern, 0), F.regexp_extract(path, pattern, 1) if "(" in pattern else F.lit("")
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(whole, F.lit("")))


def inventory(listing: DataFrame, known: DataFrame) -> DataFrame:
    """relative_path, status: the listing against what is known (path, size, mtime, sha256).

    unchanged: same size and mtime; touched: same content; changed; new; duplicate: a new path
    with content that is known or stands earlier in the listing (by lower-cased path); removed.
    """
    old = known.select(F.col("relative_path").alias("p"), F.col("size").alias("s"), F.col("mtime").alias("m"), F.col("sha256").alias("h"))
    joined = listing.join(old, listing["relative_path"] == old["p"], "full_outer")
    status = (
        F.when(F.col("relative_path").isNull(), "removed").when(F.col("p").isNull(), "new")
        .when((F.col("size") == F.col("s")) & (F.col("mtime") == F.col("m")), "unchanged").when(F.col("sha256") == F.col("h"), "touched").otherwise("changed")
    )
    rows = joined.select(F.coalesce("relative_path", "p").alias("relative_path"), "sha256", status.alias("status"))
    fresh = rows.filter("status = 'new'")
    hashes = known.filter("sha256 <> ''").select("sha256").distinct()
    first = fresh.groupBy("sha256").agg(F.min(F.struct(F.lower("relative_path"), "relative_path")).alias("first"))
    seen = fresh.join(hashes.withColumn("known", F.lit(True)), "sha256", "left").join(first, "sha256", "left")
    copy = F.col("known").isNotNull() | (F.struct(F.lower("relative_path").alias("a"), F.col("relative_path").alias("b")) != F.col("first"))
    return rows.filter("status <> 'new'").select("relative_path", "status").unionByName(
        seen.select("relative_path", F.when(copy & (F.col("sha256") != ""), "duplicate").otherwise("new").alias("status"))
    )


def exact_copies(files: DataFrame) -> DataFrame:
    """files with status: the first path (lower-cased, then as it is) of each content is the original."""
    first = files.groupBy("sha256").agg(F.min_by("relative_path", F.struct(F.lower("relative_path"), "relative_path")).alias("original"))
    return files.join(first, "sha256").withColumn("status", F.when(F.col("relative_path") == F.col("original"), "discovered").otherwise("duplicate"))


def unique_ids(entries: DataFrame) -> DataFrame:
    """entries (id, created_at, name) with later holders of a used id renumbered from the largest id on."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy("created_at", "name"))
    ranked = entries.withColumn("r", rank)
    top = entries.agg(F.max("id")).first()[0]
    again = ranked.filter("r > 1")
    # the catalogue of projects is small and on one list; its order is global by definition
    numbered = again.withColumn("k", F.row_number().over(Window.orderBy("created_at", "name", "id"))).withColumn("id", F.lit(top) + F.col("k")).drop("k")
    return ranked.filter("r = 1").unionByName(numbered).drop("r")

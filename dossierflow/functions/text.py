"""Scalar functions on text as Catalyst expressions; all null-safe in the SQL sense (null in, null out)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and what they fold to.
MARKED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY"

_HAN, _KANA, _HANGUL, _THAI = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}", r"\x{3040}-\x{30FF}\x{FF66}-\x{FF9F}", r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{FFA0}-\x{FFDC}", r"\x{0E00}-\x{0E7F}"
SCRIPTS = {"latin": r"A-Za-zÀ-ÖØ-öø-ɏ", "greek": r"\x{0370}-\x{03FF}", "cyrillic": r"\x{0400}-\x{04FF}", "han": _HAN, "kana": _KANA, "hangul": _HANGUL, "thai": _THAI}


def natural_key(text: Column) -> Column:
    """Sort key that puts doc2 before doc10: an array of lower-cased parts, digit runs padded."""
    parts = F.split(F.regexp_replace(F.lower(text), r"(\d+)", "\u0001$1\u0001"), "\u0001")
    return F.transform(parts, lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(x, 20, "0")).otherwise(x))


def fold(text: Column) -> Column:
    """Latin letters without their marks."""
    return F.translate(text, MARKED, PLAIN)


def comparable(text: Column) -> Column:
    """Folded, lower case, numbers as #, runs of everything else as one space."""
    plain = F.regexp_replace(F.lower(fold(text)), r"\d[\d.,]*\d|\d", "#")
    return F.btrim(F.regexp_replace(plain, r"(?U)[^\w#]+", " "))


def words(text: Column) -> Column:
    """Distinctive tokens in order: lower-cased, folded runs of letters and digits."""
    return F.filter(F.split(F.lower(fold(text)), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def word_ngrams(tokens: Column, n: int) -> Column:
    """Set of runs of n tokens; a shorter text is one run."""
    # shifted copies side by side: a lambda that indexed the tokens would work them out again for each run
    runs = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(0)))
    for k in range(1, n):
        runs = F.zip_with(runs, F.slice(tokens, F.lit(k + 1), F.greatest(F.size(tokens) - (n - 1), F.lit(0))), lambda x, y: F.concat_ws(" ", x, y))
    return F.when(F.size(tokens) == 0, F.array().cast("array<string>")).when(F.size(tokens) < n, F.array(F.array_join(tokens, " "))).otherwise(F.array_distinct(runs))


def settled(df, **columns: Column):
    """df with more columns, each computed once: a generator keeps the optimizer from repeating their expressions."""
    entry = F.struct(*[c.alias(k) for k, c in columns.items()])
    return df.select("*", F.explode(F.array(entry)).alias("__s")).select(*df.columns, "__s.*")


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def _beyond(text: Column) -> Column:
    """What text has from U+0370 on, where all scripts but Latin stand."""
    return F.when(F.octet_length(text) == F.length(text), F.lit("")).otherwise(F.regexp_replace(text, r"[\x{0}-\x{36F}]+", ""))


def _latin(text: Column) -> Column:
    # runs of letters go at a time, and they are fewer without blanks; a sound text has the same length on both sides
    solid = F.replace(F.make_valid_utf8(text), F.lit(" "), F.lit(""))
    return F.length(solid) - F.length(F.regexp_replace(solid, f"[{SCRIPTS['latin']}]+", ""))


def _counts(text: Column, beyond: Column) -> dict[str, Column]:
    return {name: _latin(text) if name == "latin" else F.length(F.regexp_replace(beyond, f"[^{chars}]+", "")) for name, chars in SCRIPTS.items()}


def script_counts(text: Column) -> dict[str, Column]:
    return _counts(text, _beyond(text))


def _most(counts: Column) -> Column:
    east = counts["han"] + counts["kana"]
    scored = {name: counts[name] for name in SCRIPTS} | {"kana": F.when(counts["kana"] >= 0.05 * east, east).otherwise(F.lit(0)), "han": F.when(counts["kana"] < 0.05 * F.greatest(east, F.lit(1)), east).otherwise(F.lit(0))}
    best = F.array_max(F.array(*[F.struct(c.alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, c) in enumerate(scored.items())]))
    return _let(best, lambda x: F.when(x["n"] > 0, x["name"]))


def dominant_script(text: Column) -> Column:
    """The script with most letters (kana counts for han from 5 % on); null without letters."""
    others = "".join(chars for name, chars in SCRIPTS.items() if name != "latin")

    def named(beyond: Column) -> Column:
        counted = F.struct(*[c.alias(name) for name, c in _counts(text, beyond).items()])
        # letters are counted only where scripts compete
        return F.when(beyond.rlike(f"[{others}]"), _let(counted, _most)).when(text.rlike(f"[{SCRIPTS['latin']}]"), F.lit("latin"))

    return _let(_beyond(text), named)


def without_struck(text: Column) -> Column:
    return F.regexp_replace(text, r"~~[^\n]*?~~", "")


def page_cap(text: Column, paged: Column, limit: int = 2000, whole: int = 4000, dense: int = 800) -> Column:
    """Text cut to its budget: the limit of paged formats, that of whole documents, or that of dense scripts."""
    cap = F.when(dominant_script(text).isin("han", "kana", "hangul"), F.lit(dense)).when(paged, F.lit(limit)).otherwise(F.lit(whole))
    return F.substring(text, F.lit(1), cap)


def readable(text: Column) -> Column:
    """A text with a NUL is unreadable and becomes empty."""
    return F.when(text.contains("\x00"), F.lit("")).otherwise(text)


#: Words that stand for an empty type, and for any empty field.
EMPTY_TYPES = ["NULL", "NONE", "N/A", "NA", "-", "--", "?", "DESCONHECIDO", "INDEFINIDO", "SEM TIPO"]
PLACEHOLDERS = [
    "null", "none", "nil", "undefined", "n/a", "na", "n.a", "-", "--", "?", "nenhum", "nenhuma", "ninguno", "ninguna", "desconhecido", "desconocido",
    "unknown", "não informado", "nao informado", "no informado", "not informed", "sem autor", "sin autor", "no author",
]


def normal_type(value: Column) -> Column:
    clean = F.upper(F.btrim(F.regexp_replace(value, r"\s+", " ")))
    return F.when((clean != "") & ~clean.isin(EMPTY_TYPES), clean)


def normal_date(value: Column) -> Column:
    """The finest of YYYY-MM-DD, YYYY-MM and YYYY that the value supports, or null."""
    text = F.btrim(value)
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & text.try_cast("date").isNotNull() & (F.substring(text, 1, 4) != "0000"), text)
    month = F.when(text.rlike(r"^\d{4}-\d{2}(-\d{2})?$") & F.substring(text, 6, 2).between("01", "12"), F.substring(text, 1, 7))
    year = F.when(text.rlike(r"^\d{4}(-\d{2}){0,2}$"), F.substring(text, 1, 4))
    return F.coalesce(day, month, year)


def normal_confidence(value: Column) -> Column:
    return F.when(value.isin("high", "medium", "low"), value).otherwise(F.lit("low"))


def without_placeholder(value: Column) -> Column:
    bare = F.btrim(F.lower(F.btrim(value)), F.lit("."))
    return F.when(~bare.isin(PLACEHOLDERS) & (F.btrim(value) != ""), value)


def is_norm_citation(value: Column) -> Column:
    #: Words for kinds of norms.
    kinds = (
        "lei|decreto|decreto-lei|portaria|resolu[cç][aã]o|resoluci[oó]n|instru[cç][aã]o normativa|instrucci[oó]n|medida provis[oó]ria|emenda constitucional|"
        "ato|ley|law|act|decree|ordinance|circular|delibera[cç][aã]o|parecer|of[ií]cio|edital|regulamento|norma"
    )
    return value.rlike(rf"(?iu)^\s*({kinds})(?![\p{{L}}\p{{N}}_])[^\n]{{0,40}}?\d")


def reference_number(label: Column) -> Column:
    return F.regexp_extract(label, r"(\d+)\s*$", 1).try_cast("long")


def window_base(group: Column) -> Column:
    return F.regexp_replace(group, r"(?U)[^\w\-]+", "_")


def window_key(group: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s::%06d-%06d", window_base(group), start, end)


def slug(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(fold(name)), "[^a-z0-9]+", "-"), F.lit("-"))


def markdown_cell(value: Column) -> Column:
    clean = F.btrim(F.replace(F.regexp_replace(value, r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|")))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("—"))


def clock(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)


def read_deadline(size: Column) -> Column:
    """Seconds: 600, and 120 for each MiB, at most six hours."""
    return F.least(F.lit(21600.0), F.lit(600.0) + 120 * size / 1048576)


def author_matches(expected: Column, actual: Column) -> Column:
    """The surname (last word of three letters or more) or the acronym in brackets stands in the actual author."""
    have = F.lower(fold(actual))
    acronym = F.lower(F.btrim(fold(F.regexp_extract(expected, r"\(([^)]+)\)", 1))))
    parts = F.filter(F.split(F.lower(fold(F.regexp_replace(expected, r"\([^)]*\)", " "))), "[^a-z]+"), lambda w: F.length(w) >= 3)
    surname = F.element_at(parts, -1)
    inside = F.when(F.size(parts) > 0, F.array_contains(F.split(have, "[^a-z0-9_]+"), surname)).otherwise(F.lit(False))
    return F.coalesce(((acronym != "") & have.contains(acronym)) | inside, F.lit(False))


def first_marker(text: Column, markers: dict[str, list[str]], within: int = 200) -> Column:
    """The type whose marker stands earliest, as whole words, in the first `within` upper-cased characters; ties go to the type listed first."""
    head = F.upper(F.substring(text, 1, within))
    at = lambda m: F.regexp_instr(head, F.lit(rf"(?U)\b\Q{m.upper()}\E\b"))
    found = [
        F.when(at(m) > 0, F.struct(at(m).alias("at"), F.lit(k).alias("k"), F.lit(name).alias("type")))
        for k, (name, m) in enumerate((t, m) for t, ms in markers.items() for m in ms)
    ]
    return F.array_min(F.array_compact(F.array(*found)))["type"]


def any_of(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(f"(?iu){p}") for p in patterns])


def norm_url(kind: Column, number: Column, date: Column) -> Column:
    """A resource name where kind, number and full date are known, else a search link."""
    urn = F.concat(F.lit("urn:lex:br:federal:"), F.replace(slug(kind), F.lit("-"), F.lit(".")), F.lit(":"), date, F.lit(";"), F.replace(number, F.lit("."), F.lit("")))
    return F.when(kind.isNotNull() & number.isNotNull() & date.rlike(r"^\d{4}-\d{2}-\d{2}$"), urn).otherwise(F.concat(F.lit("search:"), F.concat_ws(" ", kind, number)))

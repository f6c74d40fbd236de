"""The rules engine: page texts to pieces, from markers that the rules' tables name.

What a page says by itself (type, stamp, first line, blank) is an expression. What depends on
the pages before it is a fold over the pages of one window, whose size is fixed, so no list
grows with a group.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as t


@dataclass(frozen=True)
class Rules:
    """Markers and thresholds; loaded from configuration, with small defaults."""

    types: dict[str, list[str]] = field(default_factory=lambda: {"REPORT": ["REPORT", "BERICHT", "INFORME"], "LETTER": ["LETTER", "BRIEF", "CARTA"], "MINUTES": ["MINUTES", "ATA"]})
    headings: list[tuple[str, str]] = field(default_factory=lambda: [("LAW", r"^[#\s]*LAW\s+N")])
    protocol: list[str] = field(default_factory=lambda: ["received on", "registered under", r"protocol:"])
    summary_markers: list[str] = field(default_factory=lambda: ["Subject:"])
    author_markers: list[str] = field(default_factory=lambda: ["Signed by", "Sincerely"])
    blank: int = 10
    type_chars: int = 200
    heading_chars: int = 600
    sentence: int = 40
    summary_chars: int = 600


def _first(columns: list[Column]) -> Column:
    return F.coalesce(*columns) if columns else F.lit(None).cast("string")


def page_signals(pages: DataFrame, rules: Rules) -> DataFrame:
    """pages (…, text) with first_line, type, protocol, blank, date, summary and author of the page alone."""
    plain = t.without_struck(t.readable(F.coalesce("text", F.lit(""))))
    rows = t.settled(pages, plain=plain)
    body = F.col("plain")
    heading = _first([F.when(F.substring(body, 1, rules.heading_chars).rlike(f"(?m){p}"), F.lit(n)) for n, p in rules.headings])
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    marked = lambda markers: _first([F.nullif(F.btrim(F.regexp_extract(body, rf"(?im){m}[ \t]*:?[ \t]*([^\n]*)", 1)), F.lit("")) for m in markers])
    sentence = F.get(F.filter(F.split(body, r"(?<=[.!?])\s+"), lambda x: F.length(F.trim(x)) > rules.sentence), F.lit(0))
    return t.settled(
        rows, first_line=F.coalesce(F.get(lines, F.lit(0)), F.lit("")), type=F.coalesce(heading, t.first_marker(body, rules.types, rules.type_chars)), protocol=t.any_of(body, rules.protocol),
        blank=F.length(F.btrim(body, F.lit(" \t\r\n"))) < rules.blank, date=dates.first_date(body), summary=F.substring(F.coalesce(marked(rules.summary_markers), F.trim(sentence)), 1, rules.summary_chars),
        author=marked(rules.author_markers),
    ).drop("plain")


_ITEM = "struct<first:bigint,last:bigint,type:string,date:string,summary:string,author:string,low:boolean,typed:boolean,pages:bigint>"
_STATE = f"named_struct('items', cast(array() as array<{_ITEM}>), 'header', cast(null as string), 'seen', 0, 'blank_before', false, 'file', cast(null as string), 'whole', false)"
_CHANGED = "(x.first_line <> '' and acc.header is not null and acc.seen >= 2 and x.first_line <> acc.header)"
_NEW_FILE = "(acc.file is not null and acc.file <> x.file and (acc.whole or x.whole))"
_SIGNAL = f"(x.type is not null or x.protocol or acc.blank_before or {_CHANGED} or {_NEW_FILE})"
_OPENS = f"(size(acc.items) = 0 or {_NEW_FILE} or ({_SIGNAL} and not x.blank))"
_LAST = "element_at(acc.items, -1)"
_FRESH = f"named_struct('first', x.pos, 'last', x.pos, 'type', x.type, 'date', x.date, 'summary', x.summary, 'author', x.author, 'low', not {_SIGNAL}, 'typed', x.type is not null, 'pages', 1L)"
_GROWN = (
    f"named_struct('first', {_LAST}.first, 'last', x.pos, 'type', coalesce({_LAST}.type, x.type), 'date', coalesce({_LAST}.date, x.date), 'summary', coalesce({_LAST}.summary, x.summary), "
    f"'author', coalesce(x.author, {_LAST}.author), 'low', {_LAST}.low or not {_SIGNAL}, 'typed', {_LAST}.typed or x.type is not null, 'pages', {_LAST}.pages + 1L)"
)
_STEP = (
    f"named_struct('items', if({_OPENS}, concat(acc.items, array(cast({_FRESH} as {_ITEM}))), concat(slice(acc.items, 1, size(acc.items) - 1), array(cast({_GROWN} as {_ITEM})))), "
    "'header', if(x.first_line <> '', x.first_line, acc.header), 'seen', if(x.first_line = '', acc.seen, if(acc.header is not null and acc.header = x.first_line, acc.seen + 1, 1)), "
    "'blank_before', x.blank, 'file', x.file, 'whole', x.whole)"
)


def classify(pages: DataFrame, window: list[str], rules: Rules | None = None) -> DataFrame:
    """Pieces of each window of pages (window columns, pos, file, whole, text).

    A page opens a piece if none is open, if the document changes, or if it is not blank and
    carries a signal: a type, a stamp, a blank page before it, or a header that changes after
    it stood at least twice. A page without a signal makes its piece low. Type, date and
    summary come from the first page that has them, the author from the last.
    """
    signals = page_signals(pages, rules or Rules())
    lists = signals.groupBy(*window).agg(F.array_sort(F.collect_list(F.struct("pos", "file", "whole", "first_line", "type", "protocol", "blank", "date", "summary", "author"))).alias("m"))
    items = lists.select(*window, F.explode(F.expr(f"aggregate(m, {_STATE}, (acc, x) -> {_STEP}, acc -> acc.items)")).alias("i"))
    confidence = F.when(F.col("i.low"), "low").when(F.col("i.typed"), "high").otherwise("medium")
    return items.select(*window, F.col("i.first").alias("start_order"), F.col("i.last").alias("end_order"), "i.type", "i.date", "i.author", "i.summary", confidence.alias("confidence"), "i.pages")


def rows_to_items(pages: DataFrame, window: list[str]) -> DataFrame:
    """Pieces from a model's rows, one for each page (window, pos, file, subject, type, date, author, detail, continues).

    A piece goes on where the subject is the same, or where the row says it continues and the
    first two long words of the subject or the type of the same file agree; without a subject
    it goes on exactly where the row says so.
    """
    words = F.slice(F.filter(t.words(F.coalesce("subject", F.lit(""))), lambda w: F.length(w) > 3), 1, 2)
    rows = t.settled(pages, key=t.comparable(F.coalesce("subject", F.lit(""))), start=F.array_join(words, " "))
    entry = F.struct("pos", "file", "key", "start", "type", "date", "author", "detail", "continues")
    lists = rows.groupBy(*window).agg(F.array_sort(F.collect_list(entry)).alias("m"))
    kind = "struct<first:bigint,last:bigint,type:string,date:string,author:string,detail:string>"
    state = f"named_struct('items', cast(array() as array<{kind}>), 'pos', cast(null as bigint), 'file', cast(null as string), 'key', '', 'start', '', 'type', cast(null as string))"
    same = (
        "size(acc.items) > 0 and acc.file = x.file and x.pos = acc.pos + 1 and case when x.key <> '' and acc.key <> '' then x.key = acc.key or "
        "(coalesce(x.continues, false) and ((x.start <> '' and x.start = acc.start) or (x.type is not null and x.type = acc.type))) else coalesce(x.continues, false) end"
    )
    last = "element_at(acc.items, -1)"
    grown = f"named_struct('first', {last}.first, 'last', x.pos, 'type', coalesce({last}.type, x.type), 'date', coalesce({last}.date, x.date), 'author', coalesce({last}.author, x.author), 'detail', {last}.detail)"
    fresh = "named_struct('first', x.pos, 'last', x.pos, 'type', x.type, 'date', x.date, 'author', x.author, 'detail', x.detail)"
    step = (
        f"named_struct('items', if({same}, concat(slice(acc.items, 1, size(acc.items) - 1), array(cast({grown} as {kind}))), concat(acc.items, array(cast({fresh} as {kind})))), "
        "'pos', x.pos, 'file', x.file, 'key', if(x.key <> '', x.key, acc.key), 'start', if(x.key <> '', x.start, acc.start), 'type', x.type)"
    )
    out = lists.select(*window, F.explode(F.expr(f"aggregate(m, {state}, (acc, x) -> {step}, acc -> acc.items)")).alias("i"))
    confidence = F.when(F.col("i.type").isNotNull() & F.col("i.detail").isNotNull(), "high").otherwise("medium")
    return out.select(*window, F.col("i.first").alias("start_order"), F.col("i.last").alias("end_order"), "i.type", "i.date", "i.author", "i.detail", confidence.alias("confidence"))

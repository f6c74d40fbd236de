"""Sinks: item lines, report texts, managed blocks and packages.

Tables are written by Spark. Reports are small texts that the driver writes from aggregates;
what could be large (item tables, timelines) is written as files of a DataFrame, one row a line.
"""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STAMP = re.compile(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?")
PART_BYTES, FILE_LIMIT, CHARS_PER_TOKEN = 25 * 2**20, 30 * 2**20, 3.0
RAG_TOKENS, MAX_TOKENS = 500_000, 2_000_000


def append_lines(items: DataFrame, path: str) -> None:
    """Item rows as JSON lines; null fields are left out."""
    items.write.mode("append").json(path)


def prune_lines(lines: DataFrame, windows: DataFrame, groups: DataFrame) -> DataFrame:
    """lines (value) whose window or group is stale go; lines that cannot be parsed stay byte for byte."""
    parsed = lines.withColumn("p", F.from_json("value", "window string, `group` string"))
    keyed = parsed.select("value", F.col("p.window").alias("window"), F.col("p.group").alias("group"))
    return keyed.join(windows.select("window").distinct(), "window", "left_anti").join(groups.select("group").distinct(), "group", "left_anti").select("value")


def write_atomic(path: str, text: str) -> None:
    folder = os.path.dirname(os.path.abspath(path))
    handle, name = tempfile.mkstemp(dir=folder, suffix=".part")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as file:
            file.write(text)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def write_if_changed(path: str, text: str) -> bool:
    """Writes text unless the file has it already, timestamps apart; returns whether it wrote."""
    if os.path.exists(path):
        with open(path, encoding="utf-8", newline="") as file:
            if _STAMP.sub("", file.read()) == _STAMP.sub("", text):
                return False
    write_atomic(path, text)
    return True


def merge_managed(existing: str, generated: str, start: str = "<!-- managed:start -->", end: str = "<!-- managed:end -->") -> str:
    """existing with its managed block replaced; what the user wrote around it stays; without a block one is appended."""
    block = f"{start}\n{generated.strip()}\n{end}"
    if start in existing and end in existing.split(start, 1)[1]:
        head, rest = existing.split(start, 1)
        return head + block + rest.split(end, 1)[1]
    return (existing.rstrip() + "\n\n" if existing.strip() else "") + block + "\n"


def replace_user_part(existing: str, user: str, start: str = "<!-- managed:start -->", end: str = "<!-- managed:end -->") -> str:
    """existing with only the user's part replaced."""
    found = re.search(re.escape(start) + ".*?" + re.escape(end), existing, re.S)
    return user.rstrip() + ("\n\n" + found[0] + "\n" if found else "\n")


def timeline_lines(items: DataFrame) -> DataFrame:
    """One Markdown row for each dated piece, by date, group and order."""
    cell = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("—"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in ("date", "group_key", "start_order", "end_order", "type", "author")]), F.lit(" |"))
    dated = items.filter(F.col("date").isNotNull()).orderBy("date", "group_key", "start_order", "end_order", "line")
    return dated.select(row.alias("value"))


def review_report(counts: dict[str, DataFrame]) -> str:
    """A Markdown text of small aggregates: a section for each, its rows as a table."""
    parts = []
    for title, frame in counts.items():
        rows = frame.collect()
        table = ["| " + " | ".join(frame.columns) + " |", "|" + "-|" * len(frame.columns), *("| " + " | ".join("—" if v is None else str(v) for v in r) + " |" for r in rows)]
        parts.append(f"## {title}\n\n" + ("\n".join(table) if rows else "Nothing."))
    return "\n\n".join(parts) + "\n"


def rewrite_links(text: str, names: dict[str, str]) -> str:
    """Exact file names inside backticks and link targets replaced."""
    swap = lambda m: m[1] + names.get(m[2], m[2]) + m[3]
    return re.sub(r"(\]\()([^)\s]+)(\))", swap, re.sub(r"(`)([^`\n]+)(`)", swap, text))


def package_plan(sizes: list[tuple[str, int]]) -> tuple[list[str], int, str]:
    """(files within the limit of a file, their tokens, level ok, rag or over)."""
    inside = [(n, b) for n, b in sorted(sizes) if b <= FILE_LIMIT]
    tokens = sum(int(b / CHARS_PER_TOKEN) for _, b in inside)
    return [n for n, _ in inside], tokens, "over" if tokens > MAX_TOKENS else "rag" if tokens > RAG_TOKENS else "ok"


def write_package(path: str, files: dict[str, str]) -> list[str]:
    """A ZIP of the texts within the limit, names in order; returns the names it holds."""
    names, _, _ = package_plan([(n, len(t.encode())) for n, t in files.items()])
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for name in names:
            archive.writestr(name, files[name])
    return names


def combined(members: dict[str, dict[str, str]]) -> dict[str, str]:
    """Texts of several collections under names with the member's alias before them, links rewritten alike."""
    out = {}
    for alias, files in members.items():
        names = {n: f"{alias}-{n}" for n in files}
        out |= {names[n]: rewrite_links(text, names) for n, text in files.items()}
    return out

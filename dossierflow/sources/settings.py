"""Configuration and small inputs, checked on the driver before anything runs."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import Rules

#: What a setting may be, and windows by engine.
CHOICES = {"group_mode": ("all_together", "subfolder", "regex"), "engine": ("rules", "local", "structured", "manual"), "collection_type": ("generic", "legal", "web")}
WINDOWS = {"local": 8}
WINDOW = 16
KEY_HEADER = ["arquivo", "pagina_inicial", "pagina_final", "tipo", "data", "autor"]


@dataclass(frozen=True)
class Settings:
    """One collection's settings; `checked` makes them from untyped values."""

    name: str = ""
    source_folder: str = ""
    output_folder: str = ""
    collection_type: str = "generic"
    group_mode: str = "all_together"
    group_regex: str = ""
    engine: str = "rules"
    window: int = WINDOW
    overlap: int = 2
    page_chars: int = 4000


def checked(values: dict[str, object]) -> tuple[Settings | None, list[str]]:
    """(settings, names of what is wrong): texts of numbers become numbers, unknown names are passed over."""
    wrong, made = [], {}
    for f in fields(Settings):
        value = values.get(f.name, f.default)
        if f.type == "int":
            try:
                value = int(str(value).strip())
            except ValueError:
                wrong.append(f"{f.name}: not a whole number")
                continue
        elif not isinstance(value, str):
            wrong.append(f"{f.name}: not a text")
            continue
        made[f.name] = value
    wrong += [f"{n}: required" for n in ("name", "source_folder", "output_folder") if n in made and not made[n].strip()]
    wrong += [f"{n}: one of {', '.join(c)}" for n, c in CHOICES.items() if n in made and made[n] not in c]
    if made.get("group_mode") == "regex" and not made.get("group_regex"):
        wrong.append("group_regex: required")
    if "window" in made and not 2 <= made["window"] <= 200:
        wrong.append("window: 2 to 200")
    if "overlap" in made and "window" in made and not 0 <= made["overlap"] < made["window"]:
        wrong.append("overlap: less than the window")
    if "page_chars" in made and not 200 <= made["page_chars"] <= 100_000:
        wrong.append("page_chars: 200 to 100000")
    return (None if wrong else Settings(**made)), wrong


def window_for(engine: str) -> int:
    return WINDOWS.get(engine, WINDOW)


def inside(base: str, relative: str) -> str:
    """The real path of relative below base; a ValueError if it leads out of it."""
    root = os.path.realpath(base)
    path = os.path.realpath(os.path.join(root, relative))
    if path != root and not path.startswith(root.rstrip(os.sep) + os.sep):
        raise ValueError(f"{relative!r} is outside of {root!r}")
    return path


def rules_from(path: str) -> Rules:
    """Rules from a JSON object with some of the fields of Rules; a ValueError names what does not fit."""
    with open(path, encoding="utf-8-sig") as file:
        held = json.load(file)
    known = {f.name: f.default_factory() if callable(f.default_factory) else f.default for f in fields(Rules)}
    if not isinstance(held, dict) or (strange := sorted(set(held) - set(known))):
        raise ValueError(f"not rules: {strange if isinstance(held, dict) else type(held).__name__}")
    for name, value in held.items():
        if type(value) is not type(known[name]) or (name == "types" and not all(isinstance(m, list) and m for m in value.values())):
            raise ValueError(f"{name}: {type(known[name]).__name__} expected")
    if "headings" in held:
        held["headings"] = [tuple(h) for h in held["headings"]]
    return Rules(**held)


def answer_key(spark: SparkSession, path: str) -> DataFrame:
    """file, first_page, last_page, type, date, author of a CSV whose header must be KEY_HEADER; a byte order mark is passed over.

    Rows without a file are left out. A page that is no number makes the job fail.
    """
    rows = spark.read.option("header", "true").option("enforceSchema", "false").option("multiLine", "true").csv(path)
    names = [c.removeprefix("\ufeff") for c in rows.columns]
    if names != KEY_HEADER:
        raise ValueError(f"header {','.join(KEY_HEADER)} expected, {','.join(names)} read")
    r = rows.toDF(*names)
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    out = r.select(
        F.replace(F.trim("arquivo"), F.lit("\\"), F.lit("/")).alias("file"), F.trim("pagina_inicial").cast("int").alias("first_page"), F.trim("pagina_final").cast("int").alias("last_page"),
        text("tipo").alias("type"), text("data").alias("date"), text("autor").alias("author"),
    )
    return out.filter(F.coalesce(F.col("file"), F.lit("")) != "")

"""Counts of letters by script: results against plain Python, and their cost against one pass letter by letter."""

import random
import re
import time

from dossierflow.functions import text as t
from pyspark.sql import functions as F

POOLS = ["abc XYZ", "ÀÖ×÷ØøɏÿȦ", "αβΩ", "бвЯ", "漢字㐀", "かなカナｱﾝ", "한글ᄀﾡ", "ไทย", "  \n\t", "1.,-—“”€😀𝒳\x00", "ẞəⅣＡͯͰɐ"]


def _plain(text):
    counts = {name: len(re.findall("[" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), chars) + "]", text)) for name, chars in t.SCRIPTS.items()}
    east = counts["han"] + counts["kana"]
    kana = counts["kana"] >= 0.05 * max(east, 1)
    scored = counts | {"kana": east if kana else 0, "han": 0 if kana else east}
    best = max(scored, key=scored.get)
    return counts, best if scored[best] else None


def _texts():
    r = random.Random(6)
    mixed = ["".join(r.choice(r.choice(ps)) for _ in range(r.randint(1, 40))) for ps in (r.sample(POOLS, r.randint(1, 4)) for _ in range(600))]
    return ["", "12", "—", "a" * 96 + "漢", "漢" * 95 + "かなかなか", *mixed]


def _seconds(df):
    def once():
        start = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    return min(once() for _ in range(3))


def _prose(spark):
    return spark.range(16).select("id", F.concat(F.repeat(F.lit("A palavra está no fim da página, “sem” mais. "), 20_000), F.col("id").cast("string")).alias("text"))


def _letter_by_letter(df):
    return df.select(F.length(F.regexp_replace("text", "[^A-Za-zÀ-ÖØ-öø-ɏ]", "")))


def test_scripts_and_caps(spark):
    c = F.col("text")
    df = spark.createDataFrame([(x,) for x in [None, *_texts()]], "text string")
    for text, script, one, other in df.select("text", t.dominant_script(c), t.page_cap(c, F.lit(True), 20, 30, 8), t.page_cap(c, F.lit(False), 20, 30, 8)).collect():
        want = None if text is None else _plain(text)[1]
        assert script == want, text
        dense = want in ("han", "kana", "hangul")
        assert (one, other) == ((None, None) if text is None else (text[: 8 if dense else 20], text[: 8 if dense else 30])), text


def test_a_cap_costs_less_than_three_passes(spark):
    df = _prose(spark)
    assert _seconds(df.select(F.length(t.page_cap(F.col("text"), F.col("id") % 2 == 0)))) < 3 * _seconds(_letter_by_letter(df))


def test_counts_of_every_script(spark):
    c, texts = F.col("text"), _texts()
    counts = F.struct(*[n.alias(name) for name, n in t.script_counts(c).items()])
    for text, got in spark.createDataFrame([(x,) for x in texts], "text string").select("text", counts).collect():
        assert got.asDict() == _plain(text)[0], text
    # bytes that are not UTF-8 count as no letters
    unsound = F.concat(F.unhex(F.lit("61C3")).cast("string"), F.lit("é b"), F.unhex(F.lit("80FFE4")).cast("string"), F.lit("c"))
    assert spark.range(1).select(t.script_counts(unsound)["latin"]).first()[0] == 4


def test_script_and_letters_cost_less_than_one_pass(spark):
    df, c = _prose(spark), F.col("text")
    assert _seconds(df.select(t.dominant_script(c), t.script_counts(c)["latin"])) < _seconds(_letter_by_letter(df))

"""Folders, settings, life cycles, readers and progress against plain expectations."""

import json
import os

import pytest

from dossierflow.functions import text as t
from dossierflow.operators import lifecycle, rules, upkeep
from dossierflow.sources import admission, folder, readers, settings
from dossierflow.streaming import events
from pyspark.sql import functions as F


def made(base, files):
    for name, content in files.items():
        os.makedirs(os.path.dirname(f"{base}/{name}"), exist_ok=True)
        with open(f"{base}/{name}", "wb") as file:
            file.write(content)


def test_listing_skips_system_files_and_output_folders(spark, tmp_path):
    base = str(tmp_path / "in put+é")
    made(base, {"b/ä+1%.txt": b"x", "empty.txt": b"", "b/c/d.pdf": b"12", "out/project.json": b"{}", "out/deep/x.txt": b"1", "outer/x.txt": b"1", "~$lock.docx": b"1", "Desktop.ini": b"1"})
    got = {r["relative_path"]: r["size"] for r in folder.listing(spark, base).collect()}
    assert got == {"b/ä+1%.txt": 1, "b/c/d.pdf": 2, "outer/x.txt": 1}


def test_scan_reads_only_what_changed(spark, tmp_path):
    base = str(tmp_path / "in")
    made(base, {"a.txt": b"one", "b.txt": b"two", "c.txt": b"two", "k.txt": b"-----BEGIN X PRIVATE KEY-----", "v.exe": b"MZ", "u.xyz": b"\0\0\0"})
    known = folder.listing(spark, base).filter("relative_path in ('a.txt')").select("relative_path", "size", "mtime", F.lit("kept").alias("sha256"))
    gone = spark.createDataFrame([("old.txt",)], "relative_path string").select("relative_path", F.lit(1).cast("long").alias("size"), F.current_timestamp().alias("mtime"), F.lit("h").alias("sha256"))
    got = {r["relative_path"]: (r["status"], r["reason"]) for r in folder.scan(spark, base, known.unionByName(gone)).collect()}
    assert got == {"a.txt": ("unchanged", None), "b.txt": ("new", None), "c.txt": ("duplicate", None), "old.txt": ("removed", None), "k.txt": ("refused", "secret"), "v.exe": ("refused", "blocked_extension"), "u.xyz": ("refused", "binary")}


def test_settings_are_checked(tmp_path):
    good, wrong = settings.checked({"name": "n", "source_folder": "s", "output_folder": "o", "window": " 8 ", "overlap": "3", "strange": 1})
    assert not wrong and (good.window, good.overlap, good.engine) == (8, 3, "rules")
    assert settings.checked({"name": " ", "source_folder": "s", "output_folder": 3, "window": "x", "engine": "none", "group_mode": "regex"}) == (
        None, ["output_folder: not a text", "window: not a whole number", "name: required", f"engine: one of {', '.join(settings.CHOICES['engine'])}", "group_regex: required"],
    )
    assert settings.checked({"name": "n", "source_folder": "s", "output_folder": "o", "window": 4, "overlap": 4})[1] == ["overlap: less than the window"]
    assert [settings.window_for(e) for e in ("local", "rules", "structured")] == [8, 16, 16]
    base = str(tmp_path)
    assert settings.inside(base, "a/../b") == os.path.join(os.path.realpath(base), "b")
    for out in ("../x", "/etc/passwd", "a/../../b"):
        with pytest.raises(ValueError):
            settings.inside(base, out)


def test_rules_and_answer_keys_from_files(spark, tmp_path):
    path = str(tmp_path / "rules.json")
    made(str(tmp_path), {"rules.json": json.dumps({"types": {"BILL": ["BILL"]}, "headings": [["X", "^X"]], "blank": 3}).encode()})
    got = settings.rules_from(path)
    assert got.types == {"BILL": ["BILL"]} and got.headings == [("X", "^X")] and got.blank == 3 and got.sentence == rules.Rules().sentence
    for bad in ({"typos": {}}, {"blank": "3"}, {"types": {"A": "A"}}, []):
        made(str(tmp_path), {"rules.json": json.dumps(bad).encode()})
        with pytest.raises(ValueError):
            settings.rules_from(path)
    head = ",".join(settings.KEY_HEADER)
    made(str(tmp_path), {"key.csv": f"﻿{head}\na\\b.pdf , 1,2,Letter,,\n,3,4,x,,\nc.pdf,5,6,,2020,\"Souza, M.\"\n".encode(), "bad.csv": b"arquivo,pagina\nx,1\n"})
    assert [tuple(r) for r in settings.answer_key(spark, str(tmp_path / "key.csv")).collect()] == [("a/b.pdf", 1, 2, "Letter", "", ""), ("c.pdf", 5, 6, "", "2020", "Souza, M.")]
    with pytest.raises(ValueError):
        settings.answer_key(spark, str(tmp_path / "bad.csv"))


def test_windows_are_classified_once_even_after_a_failure(spark, tmp_path):
    path, windows = str(tmp_path / "items"), spark.createDataFrame([(f"w{k}",) for k in range(5)], "key string")
    calls = []

    def classify(pending):
        calls.append(sorted(r["key"] for r in pending.collect()))
        if len(calls) == 1:
            raise RuntimeError
        return pending.filter("key <> 'w3'").select("key", F.lit("REPORT").alias("type"))

    with pytest.raises(RuntimeError):
        lifecycle.classify_pending(spark, windows, path, classify)
    assert lifecycle.classify_pending(spark, windows.filter("key < 'w4'"), path, classify) == 4
    assert lifecycle.classify_pending(spark, windows, path, classify) == 1
    assert lifecycle.classify_pending(spark, windows, path, classify) == 0
    assert [len(c) for c in calls] == [5, 4, 1]
    rows = sorted((r["key"], r["type"]) for r in spark.read.parquet(path).collect())
    assert rows == [("w0", "REPORT"), ("w1", "REPORT"), ("w2", "REPORT"), ("w3", None), ("w4", "REPORT")]


def test_a_table_made_from_itself_is_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    upkeep.replaced(spark, spark.range(3), path)
    upkeep.replaced(spark, spark.read.parquet(path).selectExpr("id + 10 as id"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [10, 11, 12] and sorted(os.listdir(tmp_path)) == ["t"]


def test_chunks_match_a_loop(spark):
    import random

    r = random.Random(4)
    texts = ["", None, "a" * 900, "\n\n\n", *("\n".join("x" * r.randrange(120) for _ in range(r.randrange(30))) + r.choice(["", "\n"]) for _ in range(60))]

    def plain(text):
        out, held, size = [], [], 0
        for line in (text or "").split("\n")[: -1 if (text or "").endswith("\n") else None] if text else []:
            held.append(line)
            size += len(line) + 1
            if size >= 400:
                out.append("\n".join(held))
                held, size = [], 0
        return out + (["\n".join(held)] if held else [])

    got = {}
    for row in lifecycle.language_chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id", "seq").collect():
        got.setdefault(row["doc_id"], []).append(row["text"])
    assert got == {k: p for k, text in enumerate(texts) if (p := plain(text))}


def test_markers_are_whole_words(spark):
    df = spark.createDataFrame([("data of an ata here",), ("DATA only",), ("x ata. letter",), ("Étata ata é",)], "text string")
    got = [r[0] for r in df.select(t.first_marker(F.col("text"), {"LETTER": ["LETTER"], "MINUTES": ["ATA"]})).collect()]
    assert got == ["MINUTES", None, "MINUTES", "MINUTES"]


def test_subtitles_keep_spoken_numbers():
    srt = b"1\r\n00:00:01,000 --> 00:00:02,000\r\n1984\r\n{\\an8}1984\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\n<b>2</b>\r\nNOTE\r\nlost\r\n"
    assert readers.subtitle_text(srt) == "1984\n2"
    vtt = "﻿WEBVTT - title\nKind: captions\n\nSTYLE\n::cue {}\n\nintro name\n00:01.000 --> 00:02.000\nHello\n\n00:03.000 --> 00:04.000\nHello\nthere".encode()
    assert readers.subtitle_text(vtt) == "Hello\nthere"


def test_struck_stretches():
    assert readers.marked([("a ", False), (" b\n", True), (" c ", True), ("d", False), ("  ", True)]) == "a  ~~b~~\n~~c~~ d  "


def test_deep_and_repeated_parts_of_open_documents(monkeypatch):
    deep = "<d xmlns:t='t'>" + "<s>" * 500 + "<t:p>deep</t:p>" + "</s>" * 500 + "<t:table-row t:number-rows-repeated='1500'><c t:number-columns-repeated='2'><t:p>v</t:p></c></t:table-row><t:p>end</t:p></d>"
    lines = readers.opendocument_text(deep.encode()).split("\n")
    assert lines[0] == "deep" and lines[1:-1] == ["v\tv"] * 1500 and lines[-1] == "end"
    monkeypatch.setattr(readers, "MOST_CHARS", 1000)
    with pytest.raises(ValueError):
        readers.opendocument_text(deep.encode())


def test_progress_measures_from_the_last_advance(spark, tmp_path):
    schema = "run string, at double, done double, total double"

    def last(rows):
        path = str(tmp_path / f"in{len(os.listdir(tmp_path))}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        name = f"progress{len(os.listdir(tmp_path))}"
        events.progress(spark.readStream.schema(schema).parquet(path)).writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).start().awaitTermination()
        return {r["run"]: r for r in spark.table(name).collect()}

    # a reading every two seconds, an advance of one every ten: one in ten seconds, not one in two
    slow = [("s", float(at), float(at // 10), 60.0) for at in range(0, 101, 2)]
    still = [("i", 0.0, 0.0, 10.0), ("i", 10.0, 5.0, 10.0), ("i", 300.0, 5.0, 10.0)]
    done = [("d", 0.0, 0.0, 4.0), ("d", 10.0, 4.0, 4.0)]
    got = last(slow + still + done + [("n", 5.0, 1.0, 9.0)])
    assert abs(got["s"]["rate"] - 0.1) < 0.01 and 450 < got["s"]["remaining"] < 600 and not got["s"]["stalled"]
    assert got["i"]["stalled"] and got["i"]["rate"] is None and got["i"]["remaining"] is None
    assert got["d"]["remaining"] is None and got["n"]["rate"] is None


def test_decision_order(spark):
    rows = [("a.pem", b"x"), ("a.txt", b"\0"), ("a.zzz", b"\0"), ("a.zzz", None), ("a.txt", b"-----BEGIN OPENSSH PRIVATE KEY-----"), ("a.mp3", None)]
    df = spark.createDataFrame(rows, "name string, head binary")
    assert [r[0] for r in df.select(folder.decision(F.col("name"), F.col("head"))).collect()] == ["secret", None, "binary", None, "secret", "media_not_selected"]
    assert df.select(folder.decision(F.col("name"), F.col("head"), ("media",)).alias("r")).collect()[-1]["r"] is None
    assert admission.HEAD_BYTES > 0


def test_model_rows_match_a_loop(spark):
    rows = [(1, "a", "Tax return 2020", None, False), (2, "a", "tax RETURN 2020", "X", False), (3, "a", None, None, True), (4, "b", "Tax return 2020", None, True), (5, "b", "Other thing", None, False)]
    df = spark.createDataFrame([("g", p, f, s, ty, None, None, "d", c) for p, f, s, ty, c in rows], "window string, pos long, file string, subject string, type string, date string, author string, detail string, continues boolean")
    got = sorted((r["start_order"], r["end_order"], r["type"]) for r in rules.rows_to_items(df, ["window"]).collect())
    assert got == [(1, 3, "X"), (4, 4, None), (5, 5, None)]


def test_index_finds_what_a_scan_finds_and_reads_only_its_terms(spark, tmp_path):
    import random

    from dossierflow.operators import search

    r = random.Random(6)
    words = ["of", "the", "cat", "Été", "car", "dog", "one"]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randrange(1, 30)))) for k in range(200)] + [(900, ""), (901, "the the the of of the")]
    passages = spark.createDataFrame(rows, "id int, text string")
    path = str(tmp_path / "index")
    search.build_index(passages, ["id"], path)
    found = 0
    for text in ("cat", '"of the"', "ca*", 'the "the the" ca*', "cat zebra", '"the cat of"', "ete", "", '"zebra the"'):
        want = {x["id"]: round(x["score"], 9) for x in search.search(passages, text, ["id"]).collect()}
        got = {x["id"]: round(x["score"], 9) for x in search.search_index(spark, path, text, ["id"]).collect()}
        assert got == want, text
        found += len(got)
    assert found > 300
    plan = spark.read.parquet(f"{path}/postings").filter("letter = 'c' and term = 'cat'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(letter" in plan and "EqualTo(term,cat)" in plan

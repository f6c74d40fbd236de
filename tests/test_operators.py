"""Operators that SQL cannot follow, against plain Python, and the format readers."""

import io
import random
import zipfile

from dossierflow.operators import ordered, pieces, search, upkeep
from dossierflow.sources import readers
from dossierflow.streaming import events


def test_positions_and_islands_over_many_blocks(spark):
    r = random.Random(1)
    rows = [("hot" if k % 3 else r.choice("ab"), k, r.choice("xy")) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, k int, c string").repartition(7)
    got = {x["k"]: x["pos"] for x in ordered.positions(df, ["g"], ["k"]).collect()}
    for g in {g for g, _, _ in rows}:
        assert [got[k] for k in sorted(k for h, k, _ in rows if h == g)] == list(range(1, sum(h == g for h, _, _ in rows) + 1))
    runs = {x["k"]: x["island"] for x in ordered.islands(df, ["g"], ["k"], ordered.F.col("c") != ordered.F.col("before"), {"before": "c"}).collect()}
    for g in {g for g, _, _ in rows}:
        own, n, last = sorted((k, c) for h, k, c in rows if h == g), 0, None
        for k, c in own:
            n, last = n + (c != last), c
            assert runs[k] == n


def test_greedy_matching(spark):
    r = random.Random(2)
    make = lambda n: [(k, r.choice("ab"), s, s + r.randrange(5)) for k in range(n) for s in [r.randrange(30)]]
    key, index = make(40), make(40)
    schema = "id long, group_key string, start_order long, end_order long"
    got = pieces.matched(spark.createDataFrame(key, schema), spark.createDataFrame(index, schema)).collect()
    pairs = []
    for k, g, a, b in key:
        for i, h, c, d in index:
            n = min(b, d) - max(a, c) + 1
            if g == h and n > 0 and (score := n / (b - a + d - c + 2 - n)) >= 0.5:
                pairs.append((-score, k, i))
    want, used = set(), set()
    for _, k, i in sorted(pairs):
        if ("k", k) not in used and ("i", i) not in used:
            used |= {("k", k), ("i", i)}
            want.add((k, i))
    assert {(x["key_id"], x["index_id"]) for x in got} == want


def test_passages_match_a_loop(spark):
    r = random.Random(3)
    lines = [r.choice(["# Head", "Art. 5", "word " * 60, "x", ""]) for _ in range(300)]
    got = search.passages(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).orderBy("seq").collect()
    want, held, size, start = [], [], 0, 1
    for k, line in enumerate(lines, 1):
        heading = line.startswith(("#", "Art."))
        if held and ((heading and size >= 600) or size >= 2500):
            want.append((start, "\n".join(held).strip()))
            held, size = [], 0
        if not held:
            start = k
        held.append(line)
        size += len(line) + 1
    want.append((start, "\n".join(held).strip()))
    assert [(x["line"], x["text"]) for x in got] == [w for w in want if w[1]]


def test_query_parser():
    assert search.parse('Ação* "of the" (x) -y: ""') == [(["acao"], True), (["of", "the"], False), (["x"], False), (["y"], False)]


def test_append_once(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert [upkeep.append_once(spark, frame, path, ["k"]), upkeep.append_once(spark, frame, path, ["k"])] == [2, 0]


def test_progress_of_a_stream(spark, tmp_path):
    rows = [("r", float(t), float(2 * t), 400.0) for t in range(0, 60, 10)]
    schema = "run string, at double, done double, total double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = events.progress(stream).writeStream.format("memory").queryName("progress").outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.table("progress").collect()
    assert len(out) == 1 and out[0]["done"] == 100 and abs(out[0]["rate"] - 2) < 1e-9 and not out[0]["stalled"]


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


DOCX = zipped(**{"word/document.xml": '<w:d xmlns:w="w"><w:p><w:r><w:t>One </w:t></w:r><w:r><w:rPr><w:strike/></w:rPr><w:t>gone</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:d>'})
XLSX = zipped(**{"xl/sharedStrings.xml": '<s xmlns="x"><si><t>hi</t></si></s>', "xl/worksheets/sheet1.xml": '<s xmlns="x"><row><c t="s"><v>0</v></c><c><v>4</v></c></row></s>'})
PPTX = zipped(**{"ppt/slides/slide1.xml": '<s xmlns:a="a"><a:p><a:r><a:t>Title</a:t></a:r></a:p></s>', "ppt/notesSlides/notesSlide1.xml": '<s xmlns:a="a"><a:p><a:t>note</a:t></a:p></s>'})
ODT = zipped(**{"content.xml": '<d xmlns:t="t" xmlns:b="b"><t:p>para</t:p><b:table-row><b:table-cell b:number-columns-repeated="2"><t:p>c</t:p></b:table-cell></b:table-row></d>'})


def test_readers(spark):
    cases = {
        "a.txt": (b"\xef\xbb\xbfol\xc3\xa1", ["olá"]), "b.txt": ("olá".encode("cp1252"), ["olá"]), "c.html": (b"<html><head><title>x</title></head><body><h1>T</h1><p>a <del>b</del> c</p><ul><li>i</ul></body></html>", ["# T\na ~~b~~ c\n- i"]),
        "d.eml": (b"From: a@b.c\nSubject: Hi\nContent-Type: text/plain\n\nBody", ["From: a@b.c\nSubject: Hi\n\nBody"]),
        "e.mbox": (b"From x\nFrom: a@b.c\nSubject: 1\n\none\n\nFrom y\nFrom: d@e.f\nSubject: 2\n\ntwo\n", ["From: a@b.c\nSubject: 1\n\none", "From: d@e.f\nSubject: 2\n\ntwo"]),
        "f.srt": (b"1\n00:00:01,000 --> 00:00:02,000\n<i>Hi</i>\nHi\n\n2\n00:00:03,000 --> 00:00:04,000\nyou\n", ["Hi\nyou"]), "g.vtt": (b"WEBVTT\n\nNOTE x\ny\n\n00:01.000 --> 00:02.000\nHey\n", ["Hey"]),
        "h.dxf": (b"0\nTEXT\n1\nRoom\n0\nLINE\n1\nno\n0\nMTEXT\n1\n\\A1;Hall\\Pway\n", ["Room\nHall\nway"]), "i.rtf": (b"{\\rtf1{\\fonttbl x;}ol\\'e1\\par b}", ["olá\nb"]), "j.docx": (DOCX, ["One ~~gone~~\na\tb"]),
        "k.xlsx": (XLSX, ["hi\t4"]), "l.pptx": (PPTX, ["Title\nnote"]), "m.odt": (ODT, ["para\nc\tc"]), "n.xyz": (b"plain", ["plain"]), "o.xyz": (b"\x00\x01", []),
    }
    files = spark.createDataFrame([(p, bytearray(c)) for p, (c, _) in cases.items()] + [("bad.docx", bytearray(b"zzz")), ("none.txt", None)], "path string, content binary")
    got = {}
    for x in readers.read_pages(files).orderBy("path", "number").collect():
        got.setdefault(x["path"], []).append(x["text"] if x["error"] is None else x["error"])
    assert got == {p: want for p, (_, want) in cases.items() if want} | {"bad.docx": ["BadZipFile"], "none.txt": [""]}


def test_plans_are_refused_after_a_change(spark, tmp_path):
    listing = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 1.0)], "relative_path string, size long, mtime double")
    planned = upkeep.fingerprint(listing)
    page = spark.createDataFrame([("a", 1), ("b", 1)], "path string, number int")
    stale = spark.createDataFrame([("a",)], "path string")
    left = upkeep.apply_plan({"page": page, "event": stale}, stale, {"page": ["path"]}, planned, listing.repartition(3))
    assert [r["path"] for r in left["page"].collect()] == ["b"] and left["event"].count() == 1
    try:
        upkeep.apply_plan({}, stale, {}, planned, listing.withColumn("size", ordered.F.lit(3)))
        raise AssertionError
    except upkeep.StalePlanError:
        pass
    path = str(tmp_path / "grams")
    assert [upkeep.rebuilt_once(spark, path, r, lambda: page) for r in (1, 1, 2)] == [True, False, True]


def test_engine_falls_back_on_halves():
    from dossierflow.operators import engines

    class Small:
        def classify(self, pages):
            if len(pages) > 1 or pages[0]["text"] == "bad":
                raise ValueError
            return [{"start_order": pages[0]["pos"], "confidence": "high"}]

    class Any:
        def classify(self, pages):
            return [{"start_order": p["pos"], "confidence": "high"} for p in pages]

    got = engines.with_fallback(Small(), Any()).classify([{"pos": k, "text": "bad" if k == 2 else "x"} for k in range(4)])
    assert [(x["start_order"], x["confidence"]) for x in got] == [(0, "high"), (1, "high"), (2, "low"), (3, "high")]

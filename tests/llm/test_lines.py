import random

from dossierflow.llm import lines


def distance_at_most_one(x, y):
    if abs(len(x) - len(y)) > 1:
        return False
    before = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        row = [i]
        for j, d in enumerate(y, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
        before = row
    return before[-1] <= 1


def expected(docs, min_chars=lines.MIN_CHARS):
    """Text of each document after line dedup, comparing every line with all earlier ones."""
    seen, near, out = set(), [], {}
    for k, text in sorted(docs, key=lambda d: d[0]):
        if text is None:
            out[k] = None
            continue
        kept = []
        for line in text.split("\n"):
            if not line.strip(" \t\r\x0b\x0c"):
                kept.append(line)
                continue
            close = len(line) >= min_chars and any(distance_at_most_one(line, o) for o in near if line != o)
            if line not in seen and not close:
                kept.append(line)
            if line not in seen:
                seen.add(line)
                if len(line) >= min_chars:
                    near.append(line)
        out[k] = "\n".join(kept)
    return out


def changed(r, line):
    k = r.randrange(len(line))
    return r.choice([line[:k] + line[k + 1 :], line[:k] + r.choice("abcé") + line[k:], line[:k] + r.choice("xyz") + line[k + 1 :]])


def check(spark, docs, min_chars=lines.MIN_CHARS):
    got = lines.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), min_chars=min_chars).collect()
    assert {r["doc_id"]: r["text"] for r in got} == expected(docs, min_chars)
    for r in got:
        n = sum(bool(x.strip(" \t\r\x0b\x0c")) for x in (r["text"] or "").split("\n"))
        assert r["n_lines"] - r["n_removed"] == n and r["emptied"] == (r["n_removed"] > 0 and n == 0)


def test_matches_brute_force_with_crowded_keys(spark, monkeypatch):
    monkeypatch.setattr(lines, "CROWD", 4)
    r = random.Random(5)
    base = ["".join(r.choice("abcdefg hié") for _ in range(n)) for n in (25, 60, 60, 130, 400)]
    docs = []
    for k in range(90):
        picked = []
        for _ in range(3):
            line = r.choice(base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                line = changed(r, line)
            picked.append(line)
        docs.append((k, "\n".join([*picked, r.choice(["", "  ", "short", "shorter"])])))
    check(spark, docs)


def test_edge_cases(spark):
    long = "w" * 3000
    check(spark, [(1, None), (2, ""), (3, "\n \n"), (4, long), (5, long[:-1]), (6, long + "\n" + long[:-2]), (7, "tie\ntie"), (8, "tie"), (9, "é" * 30), (10, "é" * 29 + "x")])


def test_empty_table_repeated_rows_and_clashing_names(spark):
    assert lines.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "one line\ntwo", "x", 1), (1, "one line\ntwo", "x", 1), (None, "one line", "y", None), (2, None, None, 2)]
    got = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, line string, id int")).collect()
    assert {r["id"] for r in got} == {1, 2, None}
    assert sorted((r["doc_id"] or 0, r["text"], r["line"]) for r in got if r["text"] is not None) == [(0, "one line", "y"), (1, "two", "x"), (1, "two", "x")]
    assert len(got) == 4


def test_short_lines_where_they_are_asked_for(spark):
    r = random.Random(7)
    docs = [(k, "\n".join("".join(r.choice("abé ") for _ in range(r.randrange(1, 24))) for _ in range(4))) for k in range(60)]
    for least in (1, 5, 19, 20, 21):
        check(spark, docs, least)


def test_a_document_of_very_many_lines(spark):
    import time

    many = [f"line number {k // 2} of a document that has very many lines" for k in range(400_000)]
    start = time.time()
    got = lines.line_dedup(spark.createDataFrame([(1, "\n".join(["same line"] * 600_000)), (2, "\n".join(["same line", "", "own line"]))], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["text"], r["n_lines"], r["n_removed"], r["emptied"]) for r in sorted(got)] == [(1, "same line", 600_000, 599_999, False), (2, "\nown line", 2, 1, False)]
    places = lines.line_dedup(spark.createDataFrame([(1, "\n".join(many))], "doc_id long, text string"), min_chars=100).collect()[0]
    assert places["text"].split("\n") == many[::2] and places["n_removed"] == 200_000
    assert time.time() - start < 120

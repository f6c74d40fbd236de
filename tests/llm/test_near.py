"""SimHash near-dedup at a similarity against brute-force Jaccard."""

import random

import corpus_pipeline
from dossierflow.llm import near
from dossierflow.llm import simhash


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    """Smallest id of each component of pairs with a similarity of at least 0.8."""
    sets, low = {k: shingles(t) for k, t in docs}, {k: k for k, _ in docs}
    near = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    while True:
        before = dict(low)
        for a, b in near:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return low


def corpus(seed, n, words=120, bases=6):
    r = random.Random(seed)
    base = [[r.choice("abcdefgh") + str(r.randrange(60)) for _ in range(words)] for _ in range(bases)]
    common, docs = [f"c{k}" for k in range(25)], []
    for k in range(n):
        out = list(r.choice(base))
        for _ in range(r.choice([0, 1, 2, 2, 3, 4])):
            out[r.randrange(len(out))] = f"new{r.randrange(99999)}"
        if k % 3 == 0:
            out = [f"own{k}w{j}" for j in range(r.randint(5, 80))] + common
        docs.append((k * 7 % n, " ".join(out)))
    return [*docs, (n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "One  two"), (n + 4, "one")]


def check(spark, docs):
    got = near.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == brute(docs)


def test_matches_brute_force(spark):
    check(spark, corpus(1, 110, bases=30))


def test_matches_brute_force_with_crowded_shingles(spark, monkeypatch):
    monkeypatch.setattr(near, "CROWD", 4)
    check(spark, corpus(2, 110))


def test_near_stage_drops_copies_that_differ_in_many_bits(spark):
    r = random.Random(3)
    docs = []
    for k in range(40):
        words = [f"w{r.randrange(9999)}" for _ in range(200)]
        docs.append((2 * k, " ".join(words)))
        for _ in range(3):
            words[r.randrange(200)] = "changed"
        docs.append((2 * k + 1, " ".join(words)))
    far = [k for k in range(0, 80, 2) if (simhash.fingerprint(docs[k][1]) ^ simhash.fingerprint(docs[k + 1][1])).bit_count() > 3]
    assert far
    rows = [(k, t, "en", "s", len(t)) for k, t in docs]
    kept = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    want = brute(docs)
    assert {x["doc_id"] for x in kept} == {k for k, low in want.items() if k == low} == set(range(0, 80, 2))


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert near.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (9, "something else here now")]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"] or -1, x["component_id"]) for x in got) == [(-1, 3), (3, 3), (3, 3), (9, 9)]

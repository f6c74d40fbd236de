import random
import re

import numpy as np
import xxhash
from dossierflow.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(pairs):
    """Smallest id of each component, by comparing all fingerprints; an id stands for its fingerprint."""
    low = {i: i for i, _ in pairs}
    changed = True
    while changed:
        changed = False
        for i, f in pairs:
            for j, g in pairs:
                if (f ^ g).bit_count() <= 3 and low[j] < low[i]:
                    low[i], changed = low[j], True
    return low


def test_fingerprint_matches_plain_version(monkeypatch):
    r = random.Random(3)
    texts = [None, "", "  \n", "One", "A b", "É È a", *(" ".join(r.choice(["a", "B", "ß", "c d", "e"]) for _ in range(r.randrange(80))) for _ in range(40))]
    for chunk in (5, 1 << 15):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_bk_forest_matches_all_pairs():
    r = random.Random(4)
    fps = [r.getrandbits(64) for _ in range(40)]
    for _ in range(200):
        f = r.choice(fps)
        for _ in range(r.randrange(1, 5)):
            f ^= 1 << r.randrange(64)
        fps.append(f)
    fps = list(dict.fromkeys(fps))
    shard = [r.randrange(3) for _ in fps]
    got = simhash.bk_forest(np.array(shard), np.array(fps, np.uint64))
    for s in range(3):
        own = [(i, fps[i]) for i in range(len(fps)) if shard[i] == s]
        assert {i: int(got[i]) for i, _ in own} == reach(own)


def test_components_with_crowded_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 6)
    r = random.Random(5)
    base, docs = [" ".join(r.choice("abcdefgh") + str(r.randrange(30)) for _ in range(60)) for _ in range(6)], []
    for k in range(120):
        words = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            words[r.randrange(len(words))] = r.choice("xyz")
        docs.append((k * 7 % 120, " ".join(words)))
    docs += [(500, None), (501, ""), (502, "  ")]
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    prints = {k: plain_fingerprint(t) for k, t in docs}
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {k: f"{f:016x}" for k, f in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == reach(sorted(prints.items()))


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (9, "something else here now")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in got) == [(-1, 3), (3, 3), (3, 3), (9, 9)]

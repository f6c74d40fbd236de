import random
import re

import numpy as np
from dossierflow.llm import repetition


def longest(words):
    n, out = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def test_longest_repeats_match_all_pairs():
    r = random.Random(1)
    for _ in range(150):
        docs = [[r.randrange(r.choice([1, 2, 3, 9])) for _ in range(r.randrange(30))] for _ in range(4)]
        flat = np.array([x for d in docs for x in d], np.int64)
        doc = np.repeat(np.arange(4), [len(d) for d in docs])
        assert repetition.longest_repeats(flat, doc).tolist() == [x for d in docs for x in longest(d)]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    own = longest(words)
    cover = {p for i, k in enumerate(own) if k >= repetition.MIN_REPEAT for p in range(i, i + k)}
    n, top = len(words), max(own, default=0)
    failed = n < 50 or 100 * len(inside) > 50 * n
    kept = not failed and not (len(cover) > repetition.MAX_COVERED * n or (top > repetition.MAX_LONGEST and top > repetition.LONGEST_SHARE * n))
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), len(cover), top, failed, kept)


def test_measure_matches_brute_force():
    r = random.Random(2)
    texts = [None, "", " \n\t", "é" * 3, "a " * 60]
    passage = " ".join(f"p{k}" for k in range(120))
    texts += [passage + " " + " ".join(f"q{k}" for k in range(300)) + " " + passage, " ".join(f"w{k}" for k in range(80))]
    texts += [" ".join(r.choice(["a", "bé", "c#", "d|", "\n", "x y", "tail\n"]) for _ in range(r.randrange(90))) for _ in range(60)]
    assert list(zip(*repetition.measure(texts), strict=True)) == [brute(t) for t in texts]


def test_frame(spark):
    df = spark.createDataFrame([(1, None, 3), (None, "x", 4), (2, "x", 5), (2, "x", 5)], "doc_id long, text string, kept int")
    assert repetition.quality_rules(df).count() == 4
    assert repetition.quality_rules(df.limit(0)).count() == 0
    assert repetition.keep(df).columns == ["doc_id", "text", "kept"] and repetition.keep(df).count() == 0

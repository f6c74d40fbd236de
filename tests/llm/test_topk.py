import math
import random

import numpy as np
import pytest
from dossierflow.llm import topk


def plain(rows, scale=256, k=5):
    """Scores every pair of rows with whole numbers."""
    sound = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(scale * x) for x in v)]
    out = []
    for at, (q, mine) in enumerate(sound):
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(mine, v, strict=False)), i) for other, (i, v) in enumerate(sound) if other != at)[:k]
            out += [(q, n + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def check(spark, rows, kind="double", schema="vec_id long, embedding array<{}>"):
    df = spark.createDataFrame(rows, schema.format(kind))
    got = topk.top_k(df)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]
    assert sorted(map(tuple, got.collect())) == plain([(r[0], r[1]) for r in df.collect()])


@pytest.mark.parametrize("block", [4, 256])
def test_matches_scoring_every_pair(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "VECTOR_GROUP", 60)
    monkeypatch.setattr(topk, "QUERY_GROUP", 3)
    monkeypatch.setattr(topk, "FAN", 2)
    r = random.Random(10)
    rows = [(k, [r.choice([-0.5, 0.25, r.gauss(0, 1)]) for _ in range(6)]) for k in range(301)]
    rows += [(k, [0.5] * 6) for k in range(400, 460)] + [(700, None), (750, [float("nan")] * 6), (800, [1.0, None]), (850, [float("inf")]), (900, [2.0, 1.0]), (None, [9.0] * 6), (950, [])]
    check(spark, rows, "float")


def test_repeated_rows_and_rows_that_share_an_id(spark):
    rows = [(50, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [3.0, -1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [-1.0, 0.0]), (0, [-0.0, 1.0]), (0, [0.0, 1.0])]
    check(spark, rows)


def test_rows_of_one_id_that_differ_only_before_the_floor(spark):
    check(spark, [(50, [1.0, 2.0]), (50, [1.0001, 2.0]), (50, [1.0002, 2.0]), (1, [0.1, 0.1]), (1, [0.1001, 0.1]), (0, [-0.001, 0.0]), (0, [-0.002, 0.0])])


@pytest.mark.parametrize("setting", ["spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled"])
def test_partitions_that_stay_apart(spark, monkeypatch, setting):
    monkeypatch.setattr(topk, "VECTOR_GROUP", 60)
    monkeypatch.setattr(topk, "QUERY_GROUP", 3)
    r = random.Random(11)
    spark.conf.set(setting, "false")
    try:
        check(spark, [(k, [r.gauss(0, 1) for _ in range(6)]) for k in range(-60, 301)], "float")
    finally:
        spark.conf.unset(setting)


def test_components_of_any_size(spark):
    check(spark, [(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [1e15, 3.0]), (3, [1e15 + 1, 3.0]), (50, [1e12, 1e-3]), (51, [1.7e308, 0.0]), (52, [2.0**26 + 1 / 256, 2.0**26]), (53, [2.0**26, 2.0**26 + 1 / 256])])
    check(spark, [(0, [2.0**22, 2.0**22 + 1 / 256]), (1, [2.0**22, 2.0**22]), (2, [2.0**22 + 1 / 256, 2.0**22 - 1 / 256]), (3, [2.0**22 - 1 / 256, 2.0**22])])


def test_pruning_passes_over_blocks_and_seeds_pass_over_more():
    g = np.random.default_rng(1)
    centres = g.normal(0, 8, (40, 16))
    vectors = np.floor(256 * np.concatenate([c + g.normal(0, 0.3, (topk.BLOCK, 16)) for c in centres]))
    ids, ones = np.arange(len(vectors)), np.ones(len(vectors), np.int64)
    tally, seeded = [0, 0], [0, 0]
    found = list(topk.best_in(vectors[::97], ids[::97], vectors, ids, ones, 5, tally=tally))
    assert tally[0] < 0.2 * tally[1]
    seeds = np.array([s[-1] for _, _, s in found], float)
    again = list(topk.best_in(vectors[::97], ids[::97], vectors, ids, ones, 5, seeds, seeded))
    assert seeded[0] <= tally[0] and [(q, i.tolist(), s) for q, i, s in again] == [(q, i.tolist(), s) for q, i, s in found]


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>, rank int, id string, v int, n int"
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in topk.top_k(spark.createDataFrame([(0, [1.0], 1, "", 1, 1), (3, [2.0], 1, "", 1, 1)], schema)).collect()] == [(0, 1, 3, 256 * 512)]

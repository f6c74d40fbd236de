"""Exact top-k search by inner product with block-at-a-time pruning.

A term is a component of the vectors. Vectors, in the order of their ids, form blocks of
BLOCK; a block knows the largest and the smallest value of each term. For one query the
block's bound is the sum over terms of the larger product of the query's weight with the two.
Blocks are scored through their forward index (the block's own matrix) in the order of their
bounds until the bound falls below the query's kth score; blocks with a bound equal to it are
still scored, because ties go to the smaller id.

Queries and vectors meet in a grid of query groups and vector groups: each cell is a task of
bounded size. The cells of the first vector group run first; the kth score that a query has there
is where its search starts in all other groups. The best of a query merge in rounds of FAN cells.

A component is floor(scale * x). Where all products and sums of a cell stay below 2**53 they are
exact in floating point; in other cells they are Python's whole numbers, without pruning. A score
beyond the range of a long is given as its nearest long (the ranking still uses the exact one).

Rows without an id take no part, nor do vectors that are null, or hold a null or a component that
is not finite (before or after scaling). Shorter vectors count as padded with zeros. A query's own
row is not its candidate; other rows of its id are, equal ones included (rows of one id are equal if
their whole numbers are, whatever their components before the floor). Every row of a repeated query
has its own results, and a repeated vector is a candidate as often as it occurs. With fewer
than k candidates all are returned. An empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK = 256
#: Queries and vectors of a cell, about.
QUERY_GROUP, VECTOR_GROUP = 2048, 8192
#: Cells whose results for a query merge at once.
FAN = 64
_EXACT, _LONG, _HUGE = 2.0**53, (1 << 63) - 1, 10**300


def _matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _repeated(own: np.ndarray, query: np.ndarray, ids: np.ndarray, query_id: int, times: np.ndarray) -> np.ndarray:
    """How often each of some vectors is a candidate: a query's own row is one time less."""
    same = ids == query_id
    if not same.any():
        return times
    return times - (same & (own == query).all(axis=1))


def _top(scores: list, ids: np.ndarray, times: np.ndarray, k: int) -> tuple[list, np.ndarray]:
    """Scores and ids of the k best, each vector as often as it is a candidate."""
    order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])) if isinstance(scores, list) else np.lexsort((ids, -scores))
    out_s, out_i = [], []
    for i in order:
        n = min(int(times[i]), k - len(out_s))
        out_s += [scores[i]] * n
        out_i += [ids[i]] * n
        if len(out_s) == k:
            break
    return out_s, np.array(out_i, np.int64)


def best_in(
    queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, times: np.ndarray, k: int, seeds: np.ndarray | None = None, tally: list[int] | None = None
) -> Iterator[tuple[int, np.ndarray, list]]:
    """(query, ids, scores) of each query's best k vectors; vectors in the order of ids, each standing for so many rows.

    seeds: scores below which nothing is wanted. tally: gets the numbers of blocks scored and seen.
    """
    width = queries.shape[1]
    top = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(width, 1)
    if not top < _EXACT:
        whole = [[int(x) for x in v] for v in vectors]
        for q in range(len(queries)):
            mine = [int(x) for x in queries[q]]
            scores = [sum(a * b for a, b in zip(mine, v, strict=True)) for v in whole]
            found_s, found = _top(scores, ids, _repeated(vectors, queries[q], ids, query_ids[q], times), k)
            yield q, found, found_s
        return
    starts = np.arange(0, len(ids), BLOCK)
    high = np.maximum.reduceat(vectors, starts, axis=0)
    low = np.minimum.reduceat(vectors, starts, axis=0)
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    for q in range(len(queries)):
        order = np.argsort(-bounds[q], kind="stable")
        kth = -math.inf if seeds is None or math.isnan(seeds[q]) else seeds[q]
        scores, found, n = np.empty(0), np.empty(0, np.int64), 0
        for b in order:
            if bounds[q, b] < kth:
                break
            n += 1
            own = slice(starts[b], starts[b] + BLOCK)
            s, i = vectors[own] @ queries[q], ids[own]
            may = s >= kth
            if not may.any():
                continue
            count = _repeated(vectors[own], queries[q], i, query_ids[q], times[own])[may]
            best, named = _top(np.concatenate([scores, s[may]]), np.concatenate([found, i[may]]), np.concatenate([np.ones(len(found), np.int64), count]), k)
            scores, found = np.array(best, float), named
            if len(scores) == k:
                kth = max(kth, scores[-1])
        if tally is not None:
            tally[0] += n
            tally[1] += len(order)
        yield q, found, [int(s) for s in scores]


def falling(score: int) -> str:
    """A string for a whole number of any size; the order of the strings is that of falling numbers."""
    text = f"{len(str(abs(score))):05d}{abs(score)}"
    return f"b{text}" if score < 0 else "a" + text.translate(str.maketrans("0123456789", "9876543210"))


def _cell(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query": [], "query_id": [], "n": [], "vec_id": [], "score": [], "place": [], "below": []}
        if len(left) and len(right):
            right = right.sort_values(["id", "th"], kind="stable")
            width = max(max(map(len, left["v"])), max(map(len, right["v"])))
            whole = lambda side: _matrix(list(side["v"]), width)
            ids, query_ids = right["id"].to_numpy(), left["id"].to_numpy()
            names, counts = left["th"].to_numpy(), left["n"].to_numpy()
            for q, found, scores in best_in(whole(left), query_ids, whole(right), ids, right["n"].to_numpy(), k, left["seed"].to_numpy(float)):
                out["query"] += [names[q]] * len(found)
                out["query_id"] += [query_ids[q]] * len(found)
                out["n"] += [counts[q]] * len(found)
                out["vec_id"] += found.tolist()
                out["score"] += [max(-_LONG - 1, min(_LONG, x)) for x in scores]
                out["place"] += [falling(x) for x in scores]
                # no score that fits a float of this size is above it by rounding
                out["below"] += [math.nextafter(float(max(-_HUGE, min(_HUGE, x))), -math.inf) for x in scores]
        whole_columns = ("query", "query_id", "n", "vec_id", "score")
        return pd.DataFrame(out, columns=list(out)).astype({c: "int64" for c in whole_columns} | {"place": "object", "below": "float64"})

    return run


def _merged(found: DataFrame, k: int, cells: int) -> DataFrame:
    """The k best of each query among its cells' results: rounds of aggregations that each hold FAN * k entries a query."""
    entries = found.select("query", "query_id", "n", "cell", F.struct("place", "vec_id", "score").alias("e"))
    while True:
        cells = -(-cells // FAN)
        keys = ["query", "query_id", "n", (F.col("cell") % cells).alias("cell")]
        lists = entries.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list("e")), 1, k).alias("best"))
        if cells == 1:
            return lists.select("query_id", "n", F.posexplode("best").alias("p", "e"))
        entries = lists.select("query", "query_id", "n", "cell", F.explode("best").alias("e"))


def top_k(df: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each row whose id `every` divides."""
    v = F.col(vector_col)
    finite = lambda x: F.abs(x.cast("double") * scale) < F.lit(float("inf"))  # noqa: E731  false for NaN, which is larger
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & finite(x))
    # a double of 2**52 or more is whole
    floor = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
    # rows are equal if their whole numbers are: their own components may differ
    named = df.filter(F.col(id_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: floor(x.cast("double") * scale)).alias("v"))
    rows = common.cut(named.groupBy("id", "v").agg(F.count("*").alias("n")).withColumn("th", F.xxhash64("id", "v")))
    total, asked = rows.agg(F.count("*"), F.count(F.when(F.col("id") % every == 0, 1))).first()
    across, down = max(1, math.ceil(total / VECTOR_GROUP)), max(1, math.ceil(asked / QUERY_GROUP))
    # keys of a cogroup are long on both sides: an int and a long of one value hash to different partitions
    # ranges of ids would be uneven where ids are sparse; a hash deals them evenly, and each cell sorts its own
    queries = rows.filter(F.col("id") % every == 0).withColumn("r", F.pmod(F.xxhash64("th"), F.lit(down)))
    vectors = rows.withColumn("c", F.pmod(F.xxhash64(F.lit(1), "th"), F.lit(across))).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))))
    schema = "query long, query_id long, n long, vec_id long, score long, place string, below double"

    def searched(left: DataFrame, right: DataFrame) -> DataFrame:
        # both sides come from one frame: columns under new names keep Spark from taking one for the other
        other = right.select(*[F.col(c).alias(f"{c}_") for c in right.columns]).withColumnsRenamed({f"{c}_": c for c in right.columns})
        return left.groupBy("r", "c").cogroup(other.groupBy("r", "c")).applyInPandas(_cell(k), schema)

    none = F.lit(None).cast("double")
    first = searched(queries.withColumns({"c": F.lit(0).cast("long"), "seed": none}), vectors.filter("c = 0")).withColumn("cell", F.lit(0).cast("long"))
    if across == 1:
        found = first
    else:
        first = common.cut(first)
        seeds = first.groupBy("query").agg(F.count("*").alias("m"), F.min("below").alias("seed")).filter(F.col("m") == k).select("query", "seed")
        rest = queries.join(seeds, queries["th"] == seeds["query"], "left").drop("query").withColumn("c", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(across - 1).cast("long"))))
        others = searched(rest, vectors.filter("c > 0")).withColumn("cell", F.pmod(F.xxhash64("vec_id"), F.lit(across)))
        found = first.unionByName(others)
    best = _merged(found, k, across)
    own = best.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "e.vec_id", "e.score", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return own.select("query_id", "rank", "vec_id", "score")

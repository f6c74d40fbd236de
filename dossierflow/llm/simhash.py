"""SimHash near-dedup: documents link at few differing fingerprint bits; groups are connected components.

Fingerprints vote over XXH64 values of word shingles. Links between different fingerprints
are found in shards: by the pigeonhole principle two fingerprints at a distance of at most
RADIUS = 3 agree in one of four blocks of bits, so every fingerprint joins one shard for each
block and block value. A shard that is too large is dealt out again by four blocks of the bits
that remain, which is exact for the same reason; at the last level a shard cannot be larger
than the number of values of the bits left. Each shard is searched with a BK-tree whose
children are keyed by their Hamming distance to the parent. Trees belong to the task that
holds the shard: they are not broadcast, because their number grows with the collection.

A shard returns a spanning forest (each fingerprint and the smallest one that its tree can
reach), never all pairs. Components of the forest's edges come from alternating minimum and
pointer-jumping rounds, each cut by a checkpoint.

Nulls: a null text has no words, hence fingerprint zero; a null doc_id counts as larger than
any other and takes part. Repeated rows share a fingerprint and each is returned. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

RADIUS = 3
BITS = 64
SEED = 42
#: Shards of more fingerprints are dealt out again.
SHARD = 4096
#: Shingles whose votes are counted at once.
CHUNK = 1 << 15
#: Pairs of a query and a tree node that are looked at together.
FRONTIER = 1 << 18


def fingerprint(text: str | None, width: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed=SEED)
    digest, join, total = xxhash.xxh64_intdigest, b" ".join, len(words) - width + 1
    votes = np.zeros(BITS, np.int64)
    for start in range(0, total, CHUNK):
        part = words[start : start + CHUNK + width - 1]
        shingles = zip(*(part[k:] for k in range(width)), strict=False)
        votes += _votes(np.array([digest(join(s), SEED) for s in shingles], np.uint64))
    return _majority(votes, total)


def _votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def _majority(votes: np.ndarray, total: int) -> int:
    return int.from_bytes(np.packbits(2 * votes > total).tobytes(), "big")


def voted(hashes: np.ndarray) -> int:
    """The fingerprint of given 64-bit hashes; zero for none."""
    parts = [_votes(hashes[k : k + CHUNK].view(np.uint64)) for k in range(0, len(hashes), CHUNK)]
    return _majority(sum(parts), len(hashes)) if parts else 0


def _signed(values: list[int]) -> list[int]:
    return [v - (1 << 64) if v >> 63 else v for v in values]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id_col, fp): the fingerprint of each text as a signed 64-bit integer."""
    return common.per_text(df, lambda: lambda texts: [_signed([fingerprint(t, width) for t in texts])], [T.StructField("fp", T.LongType())], id_col, text_col)


def bk_links(shard: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays (row, row) of links within a shard, each link from both of its ends.

    One BK-tree for each shard, all built and searched together. shard: numbers from 0.
    """
    n = len(fp)
    order = np.argsort(shard, kind="stable")
    root_of = np.zeros(int(shard.max()) + 1, np.int64)
    root_of[shard[order[::-1]]] = order[::-1]
    parent_key = np.full(n, -1, np.int64)  # parent * 65 + distance
    waiting = np.setdiff1d(np.arange(n), root_of)
    at = root_of[shard[waiting]]
    keys, kids = np.empty(0, np.int64), np.empty(0, np.int64)  # sorted edges of the trees
    while waiting.size:
        key = at * 65 + np.bitwise_count(fp[waiting] ^ fp[at]).astype(np.int64)
        place = np.searchsorted(keys, key)
        known = (place < len(keys)) & (keys[np.minimum(place, max(len(keys) - 1, 0))] == key) if len(keys) else np.zeros(len(key), bool)
        fresh, first = np.unique(key[~known], return_index=True)
        seated = waiting[~known][first]
        parent_key[seated] = fresh
        keys = np.concatenate([keys, fresh])
        kids = np.concatenate([kids, seated])
        again = np.argsort(keys, kind="stable")
        keys, kids = keys[again], kids[again]
        stay = parent_key[waiting] < 0
        waiting, key = waiting[stay], key[stay]
        at = kids[np.searchsorted(keys, key)]
    step = max(1, FRONTIER // 64)
    for start in range(0, n, step):
        query = np.arange(start, min(start + step, n))
        node = root_of[shard[query]]
        while query.size:
            d = np.bitwise_count(fp[query] ^ fp[node]).astype(np.int64)
            near = (d <= radius) & (query != node)
            if near.any():
                yield query[near], node[near]
            begin = np.searchsorted(keys, node * 65 + np.maximum(d - radius, 0))
            stop = np.searchsorted(keys, node * 65 + np.minimum(d + radius, 64), side="right")
            count = stop - begin
            query = np.repeat(query, count)
            node = kids[np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())]


def bk_forest(shard: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The smallest index that each row reaches by links within its shard."""
    low = np.arange(len(fp))
    edges_from, edges_to, held = [], [], 0
    for query, node in bk_links(shard, fp, radius):
        edges_from.append(query)
        edges_to.append(node)
        held += len(query)
        if held > FRONTIER:
            low = merged(low, edges_from, edges_to)
            edges_from, edges_to, held = [], [], 0
    return merged(low, edges_from, edges_to)


def merged(low: np.ndarray, edges_from: list[np.ndarray], edges_to: list[np.ndarray]) -> np.ndarray:
    """Smallest index of each component, given those so far and more edges."""
    if not edges_from:
        return low
    a, b = np.concatenate(edges_from), np.concatenate(edges_to)
    low = low.copy()
    while True:
        x, y = low[a], low[b]
        if (x == y).all():
            return low
        least = np.minimum(x, y)
        np.minimum.at(low, x, least)
        np.minimum.at(low, y, least)
        while (low != (up := low[low])).any():
            low = up


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, value, fp), those of a shard together; edges (fp, root) of those that have a link."""
    held: list[np.ndarray] = []

    def edges(rows: np.ndarray) -> pa.RecordBatch:
        _, shard = np.unique(rows[:, :2], axis=0, return_inverse=True)
        fp = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
        low = bk_forest(shard.ravel(), fp)
        far = low != np.arange(len(low))
        values = fp.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(values[far]), pa.array(values[low[far]])], names=["src", "dst"])

    for batch in batches:
        rows = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
        rows = np.concatenate([*held, rows]) if held else rows
        if not len(rows):
            continue
        # the last shard may go on in the next batch
        same = (rows[:, 0] == rows[-1, 0]) & (rows[:, 1] == rows[-1, 1])
        if (~same).any():
            yield edges(rows[~same])
        held = [rows[same]]
    if held:
        yield edges(held[0])


def _split(bits: list[int]) -> list[int]:
    """Masks of four blocks of the given bits."""
    parts = np.array_split(np.array(bits), RADIUS + 1)
    return [sum(1 << int(b) for b in p) for p in parts if len(p)]


def _long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def forest(distinct: DataFrame, partitions: int | None = None) -> DataFrame:
    """(src, dst): edges that connect all fingerprints that links connect. distinct: column fp, no repeats."""
    spark = distinct.sparkSession
    masks = _split(list(range(BITS)))
    rows = distinct.select("fp", F.explode(F.array(*[F.lit(_long(m)) for m in masks])).alias("mask")).select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp")
    found, known = [], set(masks)
    while True:
        sizes = rows.groupBy("mask", "value").agg(F.count("*").alias("n")).filter("n > 1")
        last = all(BITS - m.bit_count() <= 12 for m in known)
        fits = sizes if last else sizes.filter(F.col("n") <= SHARD)
        shards = rows.join(fits.drop("n"), ["mask", "value"], "left_semi").repartition("mask", "value").sortWithinPartitions("mask", "value")
        found.append(common.cut(shards.mapInArrow(_search, "src long, dst long").distinct()))
        if last:
            break
        crowded = common.cut(rows.join(sizes.filter(F.col("n") > SHARD).drop("n"), ["mask", "value"], "left_semi"))
        here = [r["mask"] & ((1 << 64) - 1) for r in crowded.select("mask").distinct().collect()]  # a few masks, whatever the input
        if not here:
            break
        finer = {m: [m | x for x in _split([b for b in range(BITS) if not m >> b & 1])] for m in here}
        known = {x for v in finer.values() for x in v}
        choice = F.create_map(*[c for m, v in finer.items() for c in (F.lit(_long(m)), F.array(*[F.lit(_long(x)) for x in v]))])
        rows = crowded.select("fp", F.explode(choice[F.col("mask")]).alias("mask")).select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp").distinct()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for every node of an edge (src, dst).

    Alternates large-star and small-star rounds until nothing changes. A round's smallest neighbours
    are aggregates with one row a node; they are written before the join with the edges, so that a
    hub's edges are a skewed side that Spark splits. Each round's tables go when the next are written.
    """
    pairs = common.stored(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = common.stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = common.stored(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        least = common.stored(large.groupBy("u").agg(F.min("v").alias("m")))
        star = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        after = common.stored(large.join(least, "u").select(F.explode(star).alias("e")).select("e.u", "e.v").filter("u <> v").distinct())
        done = pairs.count() == after.count() and after.join(pairs, ["u", "v"], "left_anti").isEmpty()
        common.free(low, large, least, *([after] if done else [pairs]))
        if done:
            break
        pairs = after
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, extra: dict[str, Column] | None = None) -> DataFrame:
    """(id_col, fingerprint as 16 hexadecimal digits, component_id: the smallest id that links reach).

    extra: further columns of the result, named expressions over the row that a document comes from.
    """
    extra = extra or {}
    keyed = df.select(F.struct(F.col(id_col).alias("id"), *[c.alias(k) for k, c in extra.items()]).alias("k"), F.col(text_col).alias("t"))
    prints = common.cut(fingerprints(keyed, "k", "t", width).select("k.*", "fp"))
    nodes = common.cut(prints.groupBy("fp").agg(F.min("id").alias("low")))
    roots = components(forest(nodes.select("fp")))
    linked = nodes.join(roots, nodes["fp"] == roots["node"])
    best = linked.groupBy("root").agg(F.min("low").alias("best"))
    of = linked.join(best, "root").select("fp", F.col("best"))
    # written first: a join of two plain shuffles is one whose hot partitions Spark can split
    names = common.cut(nodes.join(of, "fp", "left").select("fp", F.coalesce("best", "low").alias("component_id")))
    return prints.join(names, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *extra)

"""SimHash near-dedup at a stated similarity: texts link at a Jaccard similarity of word shingles of at least 0.8.

A text is the set of its shingles of WIDTH = 5 words (words and case as in simhash.py; a text of
fewer words is one shingle). Groups are connected components. At this similarity two fingerprints
differ in ten bits or more, so blocks of equal bits cannot deal them to shards. Shards are shingles
instead: in any one order of all shingles, two sets of similarity 0.8 share one of the first
floor(n / 5) + 1 shingles of each (the front), so a shard for each shingle holds the sets that have
it in front, and no pair is lost. The order is by hash, with shingles that many fronts share moved
to the end; a bitmap of fixed size says which, and a shingle that it names by chance does no harm, as
any order will do.

Each shard has a BK-tree of its fingerprints (children keyed by their Hamming distance to the
parent) and follows only edges within RADIUS. Two sets of similarity 0.8 differ in ten bits on
average with a standard deviation of three, so RADIUS = 28 is six of these away. A pair that is found
goes on only if the common part of the fronts leaves 0.8 within reach, and is verified by its exact
intersection.

A shingle that over CROWD different sets still have in front gives no list of pairs. Its sets are
compared with a few leaders first, which joins a group of copies at a cost in proportion to its size.
What stays in different components is dealt to families (crowded shards that share sets) and to
cells of two blocks of a family; a cell searches its BK-tree, verifies against its own sets, and
returns a spanning forest of the links. So no pair of sets of one component is ever written out.

Nulls: a null text has no shingles, like an empty one; these form one group. A null id counts as
larger than any other. Very long texts are read whole. Repeated rows are each returned. An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .simhash import SEED, bk_links, components, merged, voted

WIDTH = 5
RADIUS = 28
#: A shingle that more different sets have in front is not paired at once.
CROWD = 32
#: A shingle of more fronts goes to the end of the order, but no more shingles than a quarter of the places in the bitmap.
OFTEN = 8
BITS = common.BITS
#: Times that the sets under a crowded shingle are compared with leaders.
ROUNDS = 2
#: Sets and shingles of a block of a family, about; shingles of the cell's matrix that are multiplied at once.
BLOCK, BLOCK_SHINGLES, COLUMNS = 1024, 4_000_000, 4096
#: Front shingles that one task counts, about.
BUCKET = 2_000_000
_FACTOR = 0x9E3779B97F4A7C15


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the different word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    known = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(words)}
    hashes = np.array([known[w] for w in words], np.uint64)
    span = min(width, len(words))
    total, out = len(words) - span + 1, np.full(len(words) - span + 1, span, np.uint64)
    for k in range(span):
        out = out * np.uint64(_FACTOR) + hashes[k : k + total]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out.view(np.int64))


def _name(found: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED))))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


# --- the order of shingles -----------------------------------------------------------------


def _front(found: np.ndarray, late: np.ndarray | None) -> np.ndarray:
    if late is not None and len(found):
        place = found & (BITS - 1)
        found = found[np.argsort(late[place >> 3] >> (place & 7).astype(np.uint8) & 1, kind="stable")]
    return found[: len(found) // 5 + 1]


def _counted(df: DataFrame, arrays: Callable[[pa.RecordBatch], list[np.ndarray]], buckets: int) -> DataFrame:
    """(key, c): how many rows have each number in their array, for those that more than one has.

    Numbers travel as packed arrays, added up batch by batch, to buckets by their value.
    """

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices([batch], batch.num_columns - 1):
                keys, counts = np.unique(np.concatenate([np.empty(0, np.int64), *arrays(part)]), return_counts=True)
                to = (keys.view(np.uint64) >> np.uint64(24)) % np.uint64(buckets)
                order = np.argsort(to, kind="stable")
                edges = np.searchsorted(to[order], np.arange(buckets + 1, dtype=np.uint64))
                own = [(b, order[edges[b] : edges[b + 1]]) for b in range(buckets) if edges[b] < edges[b + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in own], pa.int32()), pa.array([keys[o].tobytes() for _, o in own], pa.binary()), pa.array([counts[o].astype(np.int32).tobytes() if (counts[o] > 1).any() else None for _, o in own], pa.binary())],
                    names=["b", "k", "n"],
                )

    def added(part: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(k, np.int64) for k in part["k"]])
        counts = np.concatenate([np.ones(len(k) // 8, np.int64) if n is None else np.frombuffer(n, np.int32).astype(np.int64) for k, n in zip(part["k"], part["n"], strict=True)])
        order = np.argsort(keys, kind="stable")
        keys, first = np.unique(keys[order], return_index=True)
        total = np.add.reduceat(counts[order], first)
        return pd.DataFrame({"key": keys[total > 1], "c": total[total > 1]})

    return df.mapInArrow(dealt, "b int, k binary, n binary").groupBy("b").applyInPandas(added, "key long, c long")


def _late(texts: DataFrame, buckets: int) -> Broadcast:
    """A bitmap of the shingles that many fronts share: those of the first order, then those of the order without them."""
    bits, known = np.zeros(BITS // 8, np.uint8), None
    for _ in range(2):
        keys = common.stored(_counted(texts, lambda part, late=known: [_front(shingles(t), late and late.value) for t in part.column(0).to_pylist()], buckets).filter(F.col("c") > OFTEN))
        # the places of the most frequent ones, at most a quarter of all places
        places = keys.orderBy(F.desc("c"), "key").limit(BITS // 4).select(F.col("key").bitwiseAND(F.lit(BITS - 1)).cast("int").alias("p")).toArrow().column(0).to_numpy()
        common.free(keys)
        np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
        known = texts.sparkSession.sparkContext.broadcast(bits.copy())
    return known


# --- fronts, whole sets, links -------------------------------------------------------------


def _fronts(late: Broadcast) -> Callable[[list[str | None]], list]:
    def run(texts: list[str | None]) -> list:
        sets = [shingles(t) for t in texts]
        prints = [int(np.int64(np.uint64(voted(s)))) for s in sets]
        return [[_name(s) for s in sets], [len(s) for s in sets], prints, _lists([_front(s, late.value) for s in sets])]

    return run


def _wholes(texts: list[str | None]) -> list:
    sets = [shingles(t) for t in texts]
    return [[_name(s) for s in sets], _lists(sets)]


_SET, _LIST = T.StructField("node", T.LongType()), T.ArrayType(T.LongType())


def _wholes_of(texts: DataFrame, prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, all): the whole sets of the given nodes."""
    wanted = common.stored(prints.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("th").alias("th")).select("th"))
    found = common.per_text(common.perhaps(texts, "th", wanted), lambda: _wholes, [_SET, T.StructField("all", _LIST)], "th", "text")
    out = common.stored(found.join(wanted, "th", "left_semi").groupBy("node").agg(F.first("all").alias("all")))
    common.free(wanted)
    return out


def _verified(pairs: DataFrame, texts: DataFrame, prints: DataFrame) -> DataFrame:
    """(src, dst): the pairs (x, y) of a similarity of at least 0.8."""
    pairs = common.stored(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    wholes = _wholes_of(texts, prints, pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct())
    left = wholes.select(F.col("node").alias("x"), F.col("all").alias("p"))
    right = wholes.select(F.col("node").alias("y"), F.col("all").alias("q"))
    joined = pairs.join(left, "x").join(right, "y").select("x", "y", (F.size("p") + F.size("q")).alias("n"), F.size(F.array_intersect("p", "q")).alias("same"))
    found = common.stored(joined.filter("9 * same >= 4 * n").select(F.col("x").alias("src"), F.col("y").alias("dst")))
    common.free(pairs, wholes)
    return found


def _alike(a: str, b: str) -> Column:
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _hopeful(pairs: DataFrame) -> DataFrame:
    """(x, y) of rows (x, x_n, y, y_n, h), one for each shared shingle of the fronts; h: others that they may share.

    Up to the front that ends first, the common part is what both fronts have; beyond it lie n less
    its length of that set. So 9 * (common + beyond) >= 4 * (x_n + y_n) holds for every link.
    """
    beyond = lambda n: F.col(n) - F.floor(F.col(n) / 5) - 1
    shared = pairs.groupBy("x", "x_n", "y", "y_n").agg((F.count("*") + F.min("h")).alias("c"))
    return shared.filter(9 * (F.col("c") + F.greatest(beyond("x_n"), beyond("y_n"))) >= 4 * (F.col("x_n") + F.col("y_n"))).select("x", "y")


_PAIR = pa.schema([(c, pa.int64()) for c in ("x", "x_n", "y", "y_n", "h")])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, n, fp, h), those of a shard together; the pairs of each shard within RADIUS, by its BK-tree."""
    held: list[np.ndarray] = []

    def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, shard = np.unique(rows[:, 0], return_inverse=True)
        for a, b in bk_links(shard.ravel(), np.ascontiguousarray(rows[:, 3]).view(np.uint64), RADIUS):
            x, y = rows[a[a < b]], rows[b[a < b]]
            x, y = np.where((x[:, 1] < y[:, 1])[:, None], x, y), np.where((x[:, 1] < y[:, 1])[:, None], y, x)
            near = 5 * np.minimum(x[:, 2], y[:, 2]) >= 4 * np.maximum(x[:, 2], y[:, 2])
            x, y = x[near], y[near]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (x[:, 1], x[:, 2], y[:, 1], y[:, 2], np.minimum(x[:, 4], y[:, 4]))], schema=_PAIR)

    for batch in batches:
        rows = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)])
        rows = np.concatenate([*held, rows]) if held else rows
        if not len(rows):
            continue
        # the last shard may go on in the next batch
        same = rows[:, 0] == rows[-1, 0]
        if (~same).any():
            yield from pairs(rows[~same])
        held = [rows[same]]
    if held:
        yield from pairs(held[0])


def _cell(part: pd.DataFrame) -> pd.DataFrame:
    """(src, dst): a spanning forest of the links between the sets of one cell that are in different components."""
    sets = [np.asarray(s, np.int64) for s in part["all"]]
    node, root, size, most = (part[c].to_numpy(np.int64) for c in ("node", "root", "n", "most"))
    owner = np.repeat(np.arange(len(sets)), size)
    keys, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    shared = count[number] > 1
    owner, column = owner[shared], column[number[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common_part = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        present = np.zeros((len(sets), COLUMNS), np.float32)
        present[owner[a:b], column[a:b] - start] = 1
        common_part += present @ present.T
    low = np.arange(len(sets))
    for a, b in bk_links(np.zeros(len(sets), np.int64), part["fp"].to_numpy(np.int64).view(np.uint64), RADIUS):
        link = (root[a] != root[b]) & (9 * np.minimum(most[a], most[b]) >= 4 * (size[a] + size[b]))
        a, b = a[link], b[link]
        link = 9 * common_part[a, b] >= 4 * (size[a] + size[b])
        low = merged(low, [a[link]], [b[link]])
    far = low != np.arange(len(sets))
    return pd.DataFrame({"src": node[far], "dst": node[low[far]]})


def _between_components(placed: DataFrame, nodes: DataFrame, texts: DataFrame, prints: DataFrame) -> DataFrame:
    """(src, dst): edges that connect what links between different components connect. placed: key, node, n, fp, i, root."""
    # sets of different components share no shingle whose sets are all in one component, and pairs that share a small
    # one have been seen; so of what stands before a shared shingle only these can be common, and the rest is lost
    before = F.row_number().over(Window.partitionBy("node").orderBy("i")) - 1
    open_rows = common.stored(placed.withColumn("most", F.col("n") - F.col("i") + before).filter("5 * most >= 4 * n"))
    least = open_rows.groupBy("key").agg(F.min("node").alias("dst"))
    family = common.stored(components(common.stored(open_rows.join(common.stored(least), "key").select(F.col("node").alias("src"), "dst"))).withColumnRenamed("root", "family"))
    members = common.stored(open_rows.groupBy("node", "n", "fp", "root").agg(F.max("most").alias("most")).join(family, "node"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = common.stored(members.groupBy("family").agg(blocks.alias("blocks")))
    dealt = members.join(sizes, "family").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("family", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "n", "fp", "root", "most")
    wholes = _wholes_of(texts, prints, members.select("node").distinct())
    found = cells.join(wholes, "node").groupBy("family", "a", "b").applyInPandas(_cell, "src long, dst long")
    out = common.stored(found)
    common.free(open_rows, family, members, sizes, wholes)
    return out


def links(texts: DataFrame, prints: DataFrame, shared: DataFrame) -> DataFrame:
    """(src, dst): edges that connect all nodes that links connect. texts: th, text; prints: th, node, n, fp, front; shared: keys of two fronts or more."""
    nodes = prints.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("front").alias("front"))
    rows = common.perhaps(nodes.select(F.posexplode("front").alias("i", "key"), "node", "n", "fp"), "key", shared).select("key", "node", "n", "fp", "i")
    rows = common.stored(rows)
    sizes = common.stored(rows.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"))
    crowd = common.stored(rows.join(sizes.filter(F.col("c") > CROWD).select("key"), "key", "left_semi"))
    hidden = crowd.groupBy("node").agg(F.count("*").alias("h"))
    small = rows.join(sizes.filter(F.col("c") <= CROWD).select("key"), "key", "left_semi").join(hidden, "node", "left").select("key", "node", "n", "fp", F.coalesce("h", F.lit(0).cast("long")).alias("h"))
    few = small.repartition("key").sortWithinPartitions("key").mapInArrow(_searched, "x long, x_n long, y long, y_n long, h long")
    found = _verified(_hopeful(few), texts, prints)
    common.free(rows, sizes)
    if crowd.isEmpty():
        return found
    for k in range(ROUNDS):
        # a few leaders for all shingles, so that a group of copies meets the same ones
        # the first ones are those with the least of their own before the shingle: they are nearest to what a group has in common
        draw = F.struct((F.col("i") / F.col("n") if k == 0 else F.lit(0.0)).alias("i"), F.xxhash64("node", F.col("key").bitwiseAND(F.lit(3)), F.lit(k)).alias("d"))
        leaders = common.stored(crowd.groupBy("key").agg(F.min_by(F.struct("node", "n"), draw).alias("l")).select("key", F.col("l.node").alias("y"), F.col("l.n").alias("y_n")))
        stars = crowd.join(leaders, "key").filter("node <> y").filter(_alike("n", "y_n")).select(F.col("node").alias("x"), "y")
        found = found.unionByName(_verified(stars, texts, prints))
        roots = common.stored(components(found))
        placed = common.stored(crowd.drop("root").join(roots, "node", "left").select("key", "node", "n", "fp", "i", F.coalesce("root", "node").alias("root")))
        open_keys = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
        before, crowd = crowd, common.stored(placed.join(common.stored(open_keys), "key", "left_semi"))
        common.free(before, leaders, roots, placed)
    return found.unionByName(_between_components(crowd, nodes, texts, prints))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, th: xxhash64 of the text, node: hash of the set, component_id: the smallest id that links reach)."""
    texts = df.select(F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    # a word has a few letters and every fifth shingle is in front
    letters = df.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0]
    buckets = 1 + letters // (25 * BUCKET)
    late = _late(df.select(F.col(text_col).alias("text")), buckets)
    keyed = df.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th")).alias("k"), F.col(text_col).alias("text"))
    fields = [_SET, T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("front", _LIST)]
    prints = common.stored(common.per_text(keyed, lambda: _fronts(late), fields, "k", "text").select("k.id", "k.th", "node", "n", "fp", "front"))
    fronts = prints.select("front")
    shared = common.stored(_counted(fronts, lambda part: [part.column(0).values.to_numpy()[part.column(0).offsets[0].as_py() : part.column(0).offsets[-1].as_py()]], buckets).select("key"))
    roots = components(links(texts, prints, shared))
    lows = prints.groupBy("node").agg(F.min("id").alias("low"))
    named = common.stored(lows.join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root")))
    best = named.groupBy("root").agg(F.min("low").alias("component_id"))
    names = common.stored(named.join(best, "root").select("node", "component_id"))
    common.free(named, shared)
    return prints.select(F.col("id").alias(id_col), "th", "node").join(names, "node").select(id_col, "th", "node", "component_id")

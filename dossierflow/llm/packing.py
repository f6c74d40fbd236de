"""Best-fit packing with conflicts: texts are packed into sequences of a fixed number of words.

Two texts conflict if they have the same source or belong to the same cluster of duplicates; a
bin never holds a conflicting pair. Texts come in the order of falling length. Bins are ordered
by the room that is left and carry one bitmap of the sources and one of the clusters in them.
The search starts at the first bin that is large enough and goes on to the next larger one
until a bin is compatible: that is the tightest one. Bins are kept in runs, and each run knows
which bits all its bins have, so a run in which every bin conflicts is stepped over at once.

A text of more words than a bin has is cut into pieces; full pieces fill a bin each, and the
rest is packed like any other text.

Equal rows are counted first, and each copy is dealt to one of the shards of about SHARD rows by a
hash of all its columns and its number, so a hot source, cluster, id or repeated row spreads over
all shards; only ids, lengths, sources and hashes move, never texts.

Nulls: a null text or one without words takes no room: one row with piece 0, 0 words and a null
bin. A null source or cluster conflicts with nothing. Ties in length go by id, then by hash of
the text; repeated rows are packed as often as they occur. A very long text has as many pieces as
it needs. An empty table gives an empty result; other columns are not read.

`sequences` gives the packed text itself: one row for each bin.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY = 2048
SHARD = 8192
#: Bins in a run, at most.
RUN = 128


class Bins:
    """Open bins ordered by (room, number), in runs with the bits that all bins of a run share."""

    def __init__(self) -> None:
        self.runs: list[list[tuple[int, int]]] = []
        self.tops: list[tuple[int, int]] = []  # last entry of each run
        self.common: list[tuple[int, int]] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def _refresh(self, r: int) -> None:
        run = self.runs[r]
        if not run:
            del self.runs[r], self.tops[r], self.common[r]
            return
        s = c = -1
        for _, b in run:
            s &= self.sources[b]
            c &= self.clusters[b]
        self.tops[r], self.common[r] = run[-1], (s, c)

    def _add(self, room: int, number: int) -> None:
        entry = (room, number)
        r = min(bisect_left(self.tops, entry), len(self.runs) - 1)
        if r < 0:
            self.runs, self.tops, self.common = [[entry]], [entry], [(0, 0)]
            self._refresh(0)
            return
        insort(self.runs[r], entry)
        if len(self.runs[r]) > RUN:
            half = len(self.runs[r]) // 2
            self.runs.insert(r + 1, self.runs[r][half:])
            self.tops.insert(r + 1, self.runs[r + 1][-1])
            self.common.insert(r + 1, (0, 0))
            del self.runs[r][half:]
            self._refresh(r + 1)
            self._refresh(r)
        else:
            s, c = self.common[r]
            self.tops[r], self.common[r] = self.runs[r][-1], (s & self.sources[number], c & self.clusters[number])

    def place(self, size: int, source: int, cluster: int, capacity: int) -> tuple[int, int]:
        """(bin, room before) of the tightest compatible bin, or of a new one."""
        low = (size, -1)
        for r in range(bisect_left(self.tops, low), len(self.runs)):
            if self.common[r][0] & source or self.common[r][1] & cluster:
                continue
            run = self.runs[r]
            for i in range(bisect_left(run, low), len(run)):
                room, b = run[i]
                if not (self.sources[b] & source or self.clusters[b] & cluster):
                    del run[i]
                    self._refresh(r)
                    self.sources[b] |= source
                    self.clusters[b] |= cluster
                    if room > size:
                        self._add(room - size, b)
                    return b, room
        b = len(self.sources)
        self.sources.append(source)
        self.clusters.append(cluster)
        if capacity > size:
            self._add(capacity - size, b)
        return b, capacity


def pack(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size, in the given order."""
    bit_of: list[dict] = [{}, {}]
    bits = lambda which, value: 0 if value is None else 1 << bit_of[which].setdefault(value, len(bit_of[which]))
    several = {c for c, n in pd.Series(clusters, dtype=object).value_counts().items() if n > 1}
    bins, out = Bins(), []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        b, room = bins.place(size, bits(0, source), bits(1, cluster) if cluster in several else 0, capacity)
        out.append((b, capacity - room))
    return out


def best_fit(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, capacity: int = CAPACITY,
    size_col: str | None = None,
) -> DataFrame:
    """(id, piece, start_word, n_words, bin_id, offset) of each piece of each text.

    Without cluster_col the cluster of a text is the hash of the whole text: exact copies. Sizes are
    words; with size_col they are the numbers in that column, such as counts of tokens.
    """
    cluster = F.col(cluster_col) if cluster_col else F.xxhash64(text_col)
    rows = df.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), cluster.cast("string").alias("cluster"), F.xxhash64(text_col).alias("th"),
        (F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)) if size_col else F.coalesce(F.regexp_count(text_col, F.lit(r"\S+")), F.lit(0))).cast("long").alias("n"),
    )
    keys = ["id", "source", "cluster", "th", "n"]
    copies = rows.groupBy(*keys).agg(F.count("*").alias("times"))
    rows = copies.select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"))
    shards = max(1, math.ceil(df.select(id_col).count() / SHARD))
    schema = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("piece", "start_word", "n_words", "bin_id", "offset")),
    ])

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.assign(rest=own["n"] % capacity, null=own["id"].isna()).sort_values(["rest", "null", "id", "th"], ascending=[False, True, True, True], kind="stable")
        none = lambda column: [None if x is None or x != x else x for x in own[column]]
        ids, counts = none("id"), own["n"].tolist()
        sources, clusters = none("source"), none("cluster")
        open_rows = [i for i, n in enumerate(counts) if n % capacity]
        placed = pack([counts[i] % capacity for i in open_rows], [sources[i] for i in open_rows], [clusters[i] for i in open_rows], capacity)
        base = int(key[0]) << 32
        out: list[tuple] = [(ids[i], counts[i] // capacity, counts[i] // capacity * capacity, counts[i] % capacity, base + b, o) for i, (b, o) in zip(open_rows, placed, strict=True)]
        full = 1 << 31  # bins of full pieces
        for i, n in enumerate(counts):
            for p in range(n // capacity):
                out.append((ids[i], p, p * capacity, capacity, base + full, 0))
                full += 1
            if not n:
                out.append((ids[i], 0, 0, 0, None, 0))
        found = pd.DataFrame(out, columns=schema.names)
        return found.astype({c: "Int64" for c in schema.names[1:]})

    return rows.withColumn("shard", F.pmod(F.xxhash64(F.col("id").cast("string"), "source", "cluster", "th", "copy"), F.lit(shards))).groupBy("shard").applyInPandas(run, schema)


def sequences(df: DataFrame, placed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bin_id, text, n_words): the words of each bin's pieces in the order of their offsets, pieces apart by blank lines.

    placed: from best_fit over a df whose ids are not null and do not repeat. A bin holds at most
    the capacity in words, so the list of its pieces is bounded.
    """
    words = F.filter(F.split(text_col, r"\s+"), lambda w: w != "")
    texts = df.select(F.col(id_col).alias(id_col), words.alias("__w"))
    pieces = placed.filter("bin_id is not null").join(texts, id_col).select("bin_id", "offset", "n_words", F.array_join(F.slice("__w", F.col("start_word") + 1, F.col("n_words")), " ").alias("t"))
    lists = pieces.groupBy("bin_id").agg(F.array_sort(F.collect_list(F.struct("offset", "t"))).alias("p"), F.sum("n_words").alias("n_words"))
    return lists.select("bin_id", F.array_join("p.t", "\n\n").alias("text"), "n_words")

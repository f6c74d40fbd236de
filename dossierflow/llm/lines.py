"""Line dedup: a line goes if an equal or almost equal line stands earlier in the collection.

Two lines are almost equal at an edit distance of at most THRESHOLD = 1. By the pigeonhole
principle one of THRESHOLD + 1 = 2 segments of the shorter line then stands unchanged at the
front or at the back of the other, so each line is entered under both of its segments and
probes, for its own length and the length below, the segments that a line of that length has.
What lies between the equal parts is verified with a banded bit-parallel automaton (one bit for
each of the 2 * THRESHOLD + 1 diagonals, one word for each number of errors).

A key that many different lines share is not expanded into pairs. The same step runs again on
what its lines do not share, in PIECES segments of which all but one must be equal, and again,
until the rest of a line is at most PIECES characters long. Lines that share all but one
character can be no more than there are characters, so the last step needs no bound of its own.
No step drops a link.

Only DataFrame functions run here. Nulls: a null text stays null and has no lines. Blank lines
(spaces, tabs, carriage returns, form feeds) always stay. Lines of fewer than min_chars
characters (a parameter; MIN_CHARS = 20 unless given) are compared exactly: one edit in twenty
characters or fewer often makes another number, name or heading. The order is (doc_id, hash of
the text, line number), nulls first; rows with the same doc_id and text are one document, and each
of them is returned. A text of very many lines is cleaned at a cost in proportion to its length.
Lines are named by 128 bits of hash, segments by 64. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 1
#: Shorter lines are compared exactly.
MIN_CHARS = 20
#: A key that more different lines share is refined, in so many segments, instead of paired.
CROWD = 32
PIECES = 16
_BLANK = " \t\r\x0b\x0c"


def _lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th (hash of the text), pos, line, a and b (hash of the line): each line that is not blank."""
    # the hash below the generator: above it, each line would carry and hash the whole text
    named = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return (
        named.select("id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .filter(F.btrim("line", F.lit(_BLANK)) != "")
        .select("id", "th", "pos", "line", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))
    )


def _keys(text: Column, pieces: int, context: Column) -> Column:
    """An entry for each of (at most) pieces segments, for the text's own length (own) and for the length below.

    key: of all but that segment, where a text of that length has it; mid: what is left out.
    """
    n = F.length(text)

    def of(length: Column, own: bool) -> Column:
        segments = F.greatest(F.lit(1), F.least(F.lit(pieces), length))

        def entry(j: Column) -> Column:
            start = F.floor(j * length / segments).cast("int")
            after = (length - F.floor((j + 1) * length / segments)).cast("int")
            front, back = F.substring(text, F.lit(1), start), F.substring(text, (n - after + 1).cast("int"), after)
            fields = [F.xxhash64(context, length, j, front, back).alias("key"), F.lit(own).alias("own")]
            return F.struct(*fields, F.substring(text, (start + 1).cast("int"), (n - start - after).cast("int")).alias("mid"))

        return F.filter(F.transform(F.sequence(F.lit(0), segments - 1), entry), lambda e: length >= 0)

    return F.concat(of(n, True), of(n - 1, False))


def within_one(x: str, y: str) -> Column:
    """True if the edit distance of columns x and y is at most 1."""
    swap = F.length(x) > F.length(y)
    letters = lambda c: F.filter(F.split(c, ""), lambda v: v != "")
    xs, ys = letters(F.when(swap, F.col(y)).otherwise(F.col(x))), letters(F.when(swap, F.col(x)).otherwise(F.col(y)))
    m, n = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))

    def step(state: Column, i: Column) -> Column:
        c = F.get(state["xs"], i)
        bit = lambda d: F.when(c == F.get(state["ys"], i + (d - 1)), F.lit(1 << d)).otherwise(F.lit(0))
        mask = bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2))
        r0 = state["r0"].bitwiseAND(mask)
        r1 = state["r1"].bitwiseAND(mask).bitwiseOR(state["r0"]).bitwiseOR(F.shiftright(state["r0"], 1)).bitwiseOR(F.shiftleft(r0, 1).bitwiseAND(F.lit(7)))
        return F.struct(r0.alias("r0"), r1.alias("r1"), state["xs"].alias("xs"), state["ys"].alias("ys"))

    # the letters travel in the state: an expression outside of it would be evaluated again for each of them
    start = F.struct(F.lit(2).alias("r0"), F.lit(6).alias("r1"), xs.alias("xs"), ys.alias("ys"))
    places = F.when(m > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>"))
    end = F.aggregate(places, start, step, lambda s: s["r1"])
    return (n - m <= THRESHOLD) & (end.bitwiseAND(F.call_function("shiftleft", F.lit(1), n - m + 1)) != 0)


def _halves(lines: DataFrame, line: str, rest: bool) -> DataFrame:
    """lines exploded by the keys of the two segments, as _keys gives them for more.

    The keys are plain columns first: generated code then counts characters once for a line.
    """
    n, columns, entries = F.length(line), {}, []
    for length, own in ((n, True), (n - 1, False)):
        half = F.floor(length / 2).cast("int")
        back = (length - half).cast("int")
        for front in (True, False):
            equal = F.substring(F.col(line), F.lit(1), half) if front else F.substring(F.col(line), (n - back + 1).cast("int"), back)
            left_out = F.substring(F.col(line), (half + 1).cast("int"), n) if front else F.substring(F.col(line), F.lit(1), (n - back).cast("int"))
            k = len(entries)
            columns[f"k{k}"] = F.xxhash64(length, F.lit(front), equal)
            if rest:
                columns[f"m{k}"] = left_out
            entries.append(F.struct(F.col(f"k{k}").alias("key"), F.lit(own).alias("own"), *([F.col(f"m{k}").alias("mid")] if rest else [])))
    kept = [c for c in lines.columns if c != line]
    return lines.select(*kept, *[c.alias(k) for k, c in columns.items()]).select(*kept, F.explode(F.array(*entries)).alias("k")).select(*kept, "k.*")


def _settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with more columns, each computed once: a generator keeps the optimizer from repeating their expressions."""
    entry = F.struct(*[c.alias(k) for k, c in columns.items()])
    return rows.select("*", F.explode(F.array(entry)).alias("__s")).select(*rows.columns, "__s.*")


def _linked(crowd: DataFrame) -> DataFrame:
    """(a, b) of the later line of each pair under a key whose rests are at most one edit apart.

    crowd: key, a, b, own, first, mid; the lines of a key are few, so its list is bounded.
    """
    lists = crowd.groupBy("key").agg(F.collect_list(F.struct("a", "b", "own", "first", "mid")).alias("m"))
    pairs = lists.select(F.explode("m").alias("x"), "m").filter("x.own").select("x", F.explode("m").alias("y"))
    once = "(x.a <> y.a or x.b <> y.b) and (not y.own or struct(x.a, x.b) < struct(y.a, y.b)) and abs(length(x.mid) - length(y.mid)) <= 1"
    rests = _settled(pairs.filter(once).select("x", "y", F.col("x.mid").alias("p"), F.col("y.mid").alias("q")), m=F.least(F.length("p"), F.length("q")))
    # one edit leaves all but one of PIECES segments in place, and equal ends do not change the distance of what is between
    start = lambda j: F.floor(j * F.col("m") / PIECES).cast("int")
    after = lambda j: (F.col("m") - F.floor((j + 1) * F.col("m") / PIECES)).cast("int")
    equal = lambda j: (F.substring(F.col("p"), F.lit(1), start(j)) == F.substring(F.col("q"), F.lit(1), start(j))) & (F.right("p", after(j)) == F.right("q", after(j)))
    between = lambda c: F.substring(F.col(c), start(F.col("j")) + 1, F.length(c) - start(F.col("j")) - after(F.col("j")))
    rests = rests.select("x", "y", "p", "q", "m", F.explode(F.slice(F.filter(F.sequence(F.lit(0), F.lit(PIECES - 1)), equal), 1, 1)).alias("j"))
    near = _settled(rests.select("x", "y", "p", "q", "m", "j"), u=between("p"), v=between("q")).filter(within_one("u", "v"))
    later = F.when(F.col("x.first") < F.col("y.first"), F.struct("y.a", "y.b")).otherwise(F.struct("x.a", "x.b"))
    return near.select(later.alias("l")).select("l.a", "l.b").distinct()


def near_lines(lines: DataFrame) -> DataFrame:
    """(a, b) of lines that have an earlier line at a distance of one. lines: id, th, pos, line, a, b."""
    keys = _halves(lines.select("a", "b", "line"), "line", False)
    # keys that different lines share, one of them as its own; equal lines merge before each shuffle
    shared = keys.groupBy("key").agg(F.min("a").alias("low"), F.max("a").alias("high"), F.max("own").alias("own")).filter("own and low < high").select("key")
    shared = common.stored(shared)
    wanted = common.stored(common.perhaps(keys, "key", shared).select("key", "a", "b").distinct().join(shared, "key", "left_semi"))
    # texts only of lines that have such a key
    texts = common.perhaps(lines, "a", wanted.select("a")).groupBy("a", "b").agg(F.min(F.struct("id", "th", "pos")).alias("first"), F.min("line").alias("text"))
    texts = texts.join(wanted.select("a", "b").distinct(), ["a", "b"], "left_semi")
    rows = common.stored(_halves(texts, "text", True).join(wanted, ["key", "a", "b"], "left_semi"))
    common.free(shared, wanted)
    found = []
    while True:
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.max(F.length("mid")).alias("rest"), F.max("own").alias("own")).filter("n > 1 and own")
        bounded = (F.col("n") <= CROWD) | (F.col("rest") <= 2)
        found.append(common.stored(_linked(rows.join(sizes.filter(bounded), "key", "left_semi"))))
        crowded = rows.join(sizes.filter(~bounded), "key", "left_semi")
        finer = crowded.select("a", "b", "first", F.explode(_keys(F.col("mid"), PIECES, F.col("key"))).alias("k")).select("a", "b", "first", "k.*")
        before, rows = rows, common.stored(finer.groupBy("key", "a", "b").agg(F.max("own").alias("own"), F.min("first").alias("first"), F.min("mid").alias("mid")))
        common.free(before)
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, found).distinct()


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """df with text_col cleaned and three more columns: n_lines, n_removed, emptied.

    emptied is true where lines were removed and none that is not blank remains. All other
    columns of df are kept as they are. min_chars: shorter lines are compared exactly; with 1,
    every line goes that one edit separates from an earlier one.
    """
    places = _lines(df, id_col, text_col)
    near = common.stored(near_lines(places.filter(F.length("line") >= min_chars)))
    # equal lines merge before the shuffle, so one line that stands everywhere is a row of each task
    firsts = places.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "pos")).alias("first"))
    # written first: a join of two plain shuffles is one whose hot partitions Spark can split
    decided = common.stored(firsts.join(near.withColumn("near", F.lit(True)), ["a", "b"], "left").filter("n > 1 or near"))
    gone = (
        common.perhaps(places.select("id", "th", "pos", "a", "b"), "a", decided.select("a"))
        .join(decided, ["a", "b"])
        .filter(F.col("near").isNotNull() | (F.struct("id", "th", "pos") != F.col("first")))
        .groupBy("id", "th")
        .agg(F.sort_array(F.collect_set("pos")).alias("__gone"))
        .withColumnsRenamed({"id": "__gone_id", "th": "__gone_th"})
    )
    gone = common.stored(gone)
    common.free(near)
    # texts that lose no line stay where they are; only the others meet their places
    whole = common.perhaps(df.withColumns({"__id": F.col(id_col), "__th": F.xxhash64(text_col)}), "__th", gone.select("__gone_th"), "__hit")
    parts = F.split(F.col(text_col), "\n")
    hit, rest = whole.filter("__hit"), whole.filter("not __hit")
    joined = hit.join(gone.hint("shuffle_hash"), hit["__id"].eqNullSafe(gone["__gone_id"]) & (hit["__th"] == gone["__gone_th"]), "left").drop("__gone_id", "__gone_th")
    # a flag for each line, built gap by gap and looked up by place: the cost is that of the text
    starts, ends = F.concat(F.array(F.lit(-1)), "__gone"), F.concat("__gone", F.array(F.size(parts)))
    flags = F.flatten(F.zip_with(starts, ends, lambda s, e: F.concat(F.array_repeat(F.lit(False), e - s - 1), F.array(F.lit(True)))))
    flagged = _settled(joined, __f=F.when(F.col("__gone").isNotNull(), flags))
    stay = F.filter(parts, lambda x, i: ~F.get(F.col("__f"), i))
    every = flagged.withColumn("__clean", F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(stay, "\n"))).drop("__f")
    every = every.unionByName(rest.withColumns({"__gone": F.lit(None).cast("array<int>"), "__clean": F.col(text_col)}))
    solid = F.coalesce(F.size(F.filter(parts, lambda x: F.btrim(x, F.lit(_BLANK)) != "")), F.lit(0))
    counted = _settled(every, __n=F.when(F.col(text_col).isNotNull(), solid).otherwise(0), __m=F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")))
    out = counted.withColumns({"n_lines": F.col("__n").cast("long"), "n_removed": F.col("__m").cast("long"), "emptied": (F.col("__m") > 0) & (F.col("__m") == F.col("__n")), text_col: F.col("__clean")})
    return out.drop("__id", "__th", "__hit", "__gone", "__clean", "__n", "__m")

"""Pieces of an index: intervals of page positions within a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from . import ordered

RANK = {"low": 0, "medium": 1, "high": 2}
PIECE = T.StructType([
    T.StructField("group_key", T.StringType()), T.StructField("start_order", T.LongType()), T.StructField("end_order", T.LongType()), T.StructField("type", T.StringType()),
    T.StructField("date", T.StringType()), T.StructField("author", T.StringType()), T.StructField("confidence", T.StringType()), T.StructField("lines", T.LongType()),
])


def consolidated(items: DataFrame) -> DataFrame:
    """Overlapping pieces of one group merged where their types agree or one is null.

    Sorted by (start, end, line); the open piece takes in the next one if that starts at or
    before its end and the types are compatible, else it is done. The better confidence gives
    the fields (the first on ties), empty fields are filled from the other, the end grows.
    Since the fold never looks past a gap, groups are first cut into islands of touching
    intervals, and only an island is folded at once: its size is that of one chain of
    overlaps, not of the group.
    """
    rows = ordered.blocked(items, ["group_key"], ["start_order", "end_order", "line"])
    top = rows.groupBy("group_key", "block").agg(F.max("end_order").alias("top"))
    carried = ordered._carried(top, ["group_key"], {"carried": F.max("top")})
    inside = Window.partitionBy("block", "group_key").orderBy("start_order", "end_order", "line").rowsBetween(Window.unboundedPreceding, -1)
    reach = ordered._joined(rows.withColumn("reach", F.max("end_order").over(inside)), carried, ["group_key"])
    reach = reach.withColumn("opens", (F.col("start_order") > F.greatest("reach", "carried")).cast("long")).fillna({"opens": 1}).drop("block", "reach", "carried")
    chains = ordered.running_sum(reach, ["group_key"], ["start_order", "end_order", "line"], "opens", "chain")
    fields = ["start_order", "end_order", "line", "type", "date", "author", "confidence"]
    folded = chains.groupBy("group_key", "chain").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("m")).select("group_key", F.expr(_FOLD).alias("out"))
    return folded.select("group_key", F.explode("out").alias("p")).select("group_key", "p.start_order", "p.end_order", "p.type", "p.date", "p.author", "p.confidence", "p.lines")


_ONE = "named_struct('start_order', x.start_order, 'end_order', x.end_order, 'type', x.type, 'date', x.date, 'author', x.author, 'confidence', x.confidence, 'lines', 1L)"
_BETTER = "(array_position(array('low', 'medium', 'high'), x.confidence) > array_position(array('low', 'medium', 'high'), acc.open.confidence))"
_FILL = "if({b}, coalesce(x.{f}, acc.open.{f}), coalesce(acc.open.{f}, x.{f}))"
_MERGED = (
    "named_struct('start_order', least(acc.open.start_order, x.start_order), 'end_order', greatest(acc.open.end_order, x.end_order), "
    + ", ".join(f"'{f}', " + _FILL.format(b=_BETTER, f=f) for f in ("type", "date", "author"))
    + f", 'confidence', if({_BETTER}, x.confidence, acc.open.confidence), 'lines', acc.open.lines + 1L)"
)
_FITS = "x.start_order <= acc.open.end_order and (x.type is null or acc.open.type is null or x.type = acc.open.type)"
_KIND = "struct<start_order:bigint,end_order:bigint,type:string,date:string,author:string,confidence:string,lines:bigint>"
_START = f"named_struct('done', cast(array() as array<{_KIND}>), 'open', cast(null as {_KIND}))"
_FOLD = (
    f"aggregate(m, {_START}, (acc, x) -> case "
    f"when acc.open is null then named_struct('done', acc.done, 'open', cast({_ONE} as {_KIND})) "
    f"when {_FITS} then named_struct('done', acc.done, 'open', cast({_MERGED} as {_KIND})) "
    f"else named_struct('done', concat(acc.done, array(acc.open)), 'open', cast({_ONE} as {_KIND})) end, "
    "acc -> concat(acc.done, array(acc.open)))"
)


def trimmed(items: DataFrame) -> DataFrame:
    """Pieces whose end is drawn back before the next one, where that starts inside and ends after."""
    rows = items.withColumns({"s": -F.col("start_order"), "e": -F.col("end_order"), "l": -F.col("line")})
    after = ordered.previous(rows, ["group_key"], ["s", "e", "l"], {"next_start": "start_order", "next_end": "end_order"})
    cut = (F.col("start_order") < F.col("next_start")) & (F.col("next_start") <= F.col("end_order")) & (F.col("end_order") < F.col("next_end"))
    return after.withColumn("end_order", F.when(cut, F.col("next_start") - 1).otherwise(F.col("end_order"))).drop("s", "e", "l", "next_start", "next_end")


def covered_pages(items: DataFrame, sizes: DataFrame) -> DataFrame:
    """group_key, pages, covered, classified: positions 1..pages of a group in any piece, and in any that is not low.

    Pieces are clamped to their group; each becomes positions, so the join is an equality.
    """
    clamped = items.join(sizes, "group_key").select(
        "group_key", "confidence", F.greatest("start_order", F.lit(1)).alias("a"), F.least("end_order", "pages").alias("b")
    )
    spots = clamped.filter("a <= b").select("group_key", F.explode(F.sequence("a", "b")).alias("pos"), (F.col("confidence") != "low").alias("sure"))
    spots = spots.groupBy("group_key", "pos").agg(F.bool_or("sure").alias("sure"))
    counts = spots.groupBy("group_key").agg(F.count("*").alias("covered"), F.count_if("sure").alias("classified"))
    return sizes.join(counts, "group_key", "left").select("group_key", "pages", F.coalesce("covered", F.lit(0)).alias("covered"), F.coalesce("classified", F.lit(0)).alias("classified"))


def gaps(items: DataFrame, sizes: DataFrame) -> DataFrame:
    """group_key, first, last: runs of positions that no piece covers."""
    spots = items.select("group_key", F.explode(F.sequence("start_order", "end_order")).alias("pos")).distinct()
    missing = sizes.select("group_key", F.explode(F.sequence(F.lit(1).cast("long"), "pages")).alias("pos")).join(spots, ["group_key", "pos"], "left_anti")
    runs = ordered.positions(missing, ["group_key"], ["pos"], "rn")
    return runs.groupBy("group_key", (F.col("pos") - F.col("rn")).alias("k")).agg(F.min("pos").alias("first"), F.max("pos").alias("last")).drop("k")


def problems(items: DataFrame, sizes: DataFrame) -> DataFrame:
    """items with the list of what is wrong with each (empty for sound ones)."""
    joined = items.join(sizes, "group_key", "left")
    checks = F.array_compact(F.array(
        F.when(F.coalesce("group_key", F.lit("")) == "", F.lit("no group")),
        F.when(F.col("start_order").isNull() | F.col("end_order").isNull(), F.lit("order is no integer")),
        F.when(F.col("start_order") > F.col("end_order"), F.lit("order is inverted")),
        F.when(F.col("date").isNotNull() & ~t.normal_date(F.col("date")).eqNullSafe(F.col("date")), F.lit("date is not canonical")),
        F.when(~F.col("confidence").isin("high", "medium", "low"), F.lit("unknown confidence")),
        F.when((F.col("start_order") < 1) | (F.col("end_order") > F.coalesce("pages", F.lit(0))), F.lit("outside the group")),
    ))
    return joined.withColumn("problems", checks)


def matched(key: DataFrame, index: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs key_id, index_id, score: best Jaccard of pages first, each piece once.

    key and index: id, group_key, start_order, end_order. Pairs come from an equality join on
    pages. The greedy choice runs in rounds: a pair is taken when it is the best of both its
    pieces, which is what taking the best pair of all again and again comes to.
    """
    spot = lambda df, n: df.select(F.col("id").alias(n), "group_key", F.explode(F.sequence("start_order", "end_order")).alias("pos"))
    size = lambda df, n: df.select(F.col("id").alias(n), (F.col("end_order") - F.col("start_order") + 1).alias(f"{n}_n"))
    both = spot(key, "key_id").join(spot(index, "index_id"), ["group_key", "pos"]).groupBy("key_id", "index_id").agg(F.count("*").alias("n"))
    scored = both.join(size(key, "key_id"), "key_id").join(size(index, "index_id"), "index_id")
    scored = scored.select("key_id", "index_id", (F.col("n") / (F.col("key_id_n") + F.col("index_id_n") - F.col("n"))).alias("score"))
    ordered.shared_folder(scored)
    left, found = scored.filter(F.col("score") >= threshold).checkpoint(), None
    while not left.isEmpty():
        rank = F.struct(-F.col("score"), F.col("key_id"), F.col("index_id"))
        ranked = left.withColumn("rank", rank)
        a, b = (ranked.groupBy(c).agg(F.min("rank").alias("best")) for c in ("key_id", "index_id"))
        taken = ranked.join(a, "key_id").filter("rank = best").drop("best").join(b, "index_id").filter("rank = best").select("key_id", "index_id", "score").checkpoint()
        found = taken if found is None else found.unionByName(taken)
        left = left.join(taken.select("key_id"), "key_id", "left_anti").join(taken.select("index_id"), "index_id", "left_anti").checkpoint()
    return found if found is not None else scored.limit(0)

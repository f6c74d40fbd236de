"""Full-text search over passages: postings, phrases, prefixes, and BM25 ranking."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t

K1, B, FLOOR = 1.2, 0.75, 1e-6
#: Soft and hard length of a passage.
SOFT, HARD = 600, 2500


def passages(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, seq, line, text: a document cut on line ends.

    A passage closes before a heading from SOFT characters on and anywhere from HARD on. The
    fold runs over the lines of one document.
    """
    heading = r"^(?:~~)?\s*(?:#+\s*)?(?:Art\.?\s*\d+|(?:CAP[ÍI]TULO|T[ÍI]TULO|LIVRO|PARTE|SE[ÇC][ÃA]O)\s+[IVXLCDM\d]+|ANEXO)|^#+\s+."
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).cast("long").alias("line"), x.alias("t"), x.rlike(heading).alias("h"), (F.length(x) + 1).cast("long").alias("n")))
    kind = "struct<line:bigint,size:bigint,parts:array<string>>"
    fold = f"""aggregate(l, cast(array() as array<{kind}>), (acc, x) ->
        if(size(acc) = 0 or (x.h and element_at(acc, -1).size >= {SOFT}) or element_at(acc, -1).size >= {HARD},
            concat(acc, array(named_struct('line', x.line, 'size', x.n, 'parts', array(x.t)))),
            concat(slice(acc, 1, size(acc) - 1), array(named_struct('line', element_at(acc, -1).line, 'size', element_at(acc, -1).size + x.n, 'parts', concat(element_at(acc, -1).parts, array(x.t)))))))"""
    rows = docs.select(F.col(id_col), lines.alias("l")).select(id_col, F.posexplode(F.expr(fold)).alias("p", "b"))
    return rows.select(id_col, (F.col("p") + 1).alias("seq"), "b.line", F.btrim(F.array_join("b.parts", "\n"), F.lit(" \n\t")).alias("text")).filter("text <> ''")


def postings(passages: DataFrame, key: list[str]) -> DataFrame:
    """key..., term, tf, positions, dl: one row for each term of each passage."""
    tokens = passages.select(*key, t.words(F.col("text")).alias("w")).select(*key, F.size("w").alias("dl"), F.posexplode("w").alias("pos", "term"))
    return tokens.groupBy(*key, "term").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"), F.first("dl").alias("dl"))


def parse(text: str) -> list[tuple[list[str], bool]]:
    """The user's words: (tokens of a word or "quoted phrase", whether it is a prefix*); operators mean nothing."""
    out = []
    for phrase, word in re.findall(r'"([^"]+)"|(\S+)', text):
        clean = re.sub(r'["*^:()\-+{}\[\]]', " ", phrase or word)
        parts = [p for p in re.split(r"[^\w]+", clean.lower().translate(str.maketrans(t.MARKED, t.PLAIN))) if p]
        if phrase and parts:
            out.append((parts, False))
        elif parts:
            out += [([p], word.endswith("*")) for p in parts]
    return out


def _idf(total: int, n: Column) -> Column:
    raw = F.log((F.lit(float(total)) - n + 0.5) / (n + 0.5))
    return F.when(raw <= 0, F.lit(FLOOR)).otherwise(raw)


def search(passages: DataFrame, query: str, key: list[str]) -> DataFrame:
    """key..., score by BM25: passages that hold every word, phrase and prefix of the query, in no order.

    For a few searches over passages that have no index: every text is read. `search_index` reads
    only the query's terms.
    """
    terms = parse(query)
    tokens = t.settled(passages.select(*key, "text"), w=t.words(F.col("text"))).drop("text")
    stats = tokens.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avg")).first()
    total, average = stats["n"], stats["avg"] or 1.0

    def hits(words: list[str], prefix: bool) -> Column:
        if prefix:
            return F.size(F.filter("w", lambda x: x.startswith(words[0])))
        if len(words) == 1:
            return F.size(F.filter("w", lambda x: x == words[0]))
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - len(words), F.lit(0))), lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.get("w", i + k) == x, F.lit(False)) for k, x in enumerate(words)]))
        return F.size(F.filter(runs, lambda x: x))

    counted = tokens.select(*key, F.size("w").alias("dl"), *[hits(w, p).alias(f"t{k}") for k, (w, p) in enumerate(terms)])
    any_hit = counted.filter(reduce(lambda a, b: a | b, [F.col(f"t{k}") > 0 for k in range(len(terms))])) if terms else counted.limit(0)
    df = any_hit.agg(*[F.count_if(F.col(f"t{k}") > 0).alias(f"n{k}") for k in range(len(terms))]).first() if terms else None
    score = F.lit(0.0)
    for k in range(len(terms)):
        tf = F.col(f"t{k}")
        score = score + _idf(total, F.lit(float(df[f"n{k}"]))) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / average))
    found = any_hit.filter(reduce(lambda a, b: a & b, [F.col(f"t{k}") > 0 for k in range(len(terms))])) if terms else any_hit
    return found.select(*key, score.alias("score"))


def build_index(passages: DataFrame, key: list[str], path: str) -> None:
    """Writes postings (in folders by the first letter of the term, sorted by term) and the passages' sizes below path."""
    rows = postings(passages, key)
    rows.withColumn("letter", F.substring("term", 1, 1)).repartition("letter", F.pmod(F.xxhash64("term"), F.lit(16))).sortWithinPartitions("term").write.mode("overwrite").partitionBy("letter").parquet(f"{path}/postings")
    sizes = passages.select(F.size(t.words(F.col("text"))).alias("dl"))
    sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("avg")).write.mode("overwrite").parquet(f"{path}/stats")


def search_index(spark: SparkSession, path: str, query: str, key: list[str]) -> DataFrame:
    """key..., score, as search gives them, from an index that build_index wrote.

    The filters on letter and term reach the files, so only the postings of the query's terms are
    read. A phrase counts the places from which all its words follow each other.
    """
    terms = parse(query)
    rows = spark.read.option("basePath", f"{path}/postings").parquet(f"{path}/postings")
    if not terms:
        return rows.select(*key, F.lit(0.0).alias("score")).limit(0)
    stats = spark.read.parquet(f"{path}/stats").first()
    total, average = stats["n"], stats["avg"] or 1.0
    hits = []
    for k, (words, prefix) in enumerate(terms):
        if prefix:
            own = rows.filter((F.col("letter") == words[0][:1]) & F.col("term").startswith(words[0])).groupBy(*key).agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
        elif len(words) == 1:
            own = rows.filter((F.col("letter") == words[0][:1]) & (F.col("term") == words[0])).select(*key, "tf", "dl")
        else:
            wanted = sorted(set(words))
            some = rows.filter(F.col("letter").isin(*{w[:1] for w in wanted}) & F.col("term").isin(*wanted))
            places = [F.first(F.when(F.col("term") == w, F.col("positions")), ignorenulls=True).alias(f"p{i}") for i, w in enumerate(wanted)]
            full = some.groupBy(*key).agg(F.first("dl").alias("dl"), F.count("*").alias("c"), *places).filter(F.col("c") == len(wanted))
            starts = [F.expr(f"transform(p{wanted.index(w)}, p -> p - {i})") for i, w in enumerate(words)]
            own = full.select(*key, F.size(reduce(F.array_intersect, starts)).cast("long").alias("tf"), "dl").filter("tf > 0")
        hits.append(own.select(*key, "dl", "tf", F.lit(k).alias("k")))
    every = reduce(DataFrame.unionByName, hits)
    counts = {r["k"]: r["c"] for r in every.groupBy("k").agg(F.count("*").alias("c")).collect()}  # a row for each term of the query
    tf = [F.coalesce(F.sum(F.when(F.col("k") == k, F.col("tf"))), F.lit(0)) for k in range(len(terms))]
    joined = every.groupBy(*key).agg(F.first("dl").alias("dl"), F.count("*").alias("c"), *[x.alias(f"t{k}") for k, x in enumerate(tf)]).filter(F.col("c") == len(terms))
    score = reduce(lambda a, b: a + b, [_idf(total, F.lit(float(counts.get(k, 0)))) * F.col(f"t{k}") * (K1 + 1) / (F.col(f"t{k}") + K1 * (1 - B + B * F.col("dl") / average)) for k in range(len(terms))])
    return joined.select(*key, score.alias("score"))


def char_trigrams(text: Column) -> Column:
    """Distinct runs of three characters, for scripts without spaces."""
    flat = F.regexp_replace(F.lower(text), r"\s+", "")
    return F.when(F.length(flat) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(flat) - 2), lambda i: F.substring(flat, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def snippet(text: Column, term: str, radius: int = 80) -> Column:
    """What stands around the first place of term, at most radius characters on either side."""
    at = F.instr(F.lower(text), term.lower())
    start = F.greatest(at - radius, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + len(term) + radius))

"""Language ID: kernel ridge regression on blended-spectrum presence kernels.

The kernel of two texts is the number of letter n-grams of one to three letters that both
have, divided by the geometric mean of how many each has. An n-gram is named by a hash of its
lower-case code points, so every script has n-grams of its own. Nystroem landmarks stand for all
texts: the features of a text are its kernels with the landmarks, multiplied by the inverse
square root of the landmarks' own kernel matrix. One-versus-rest ridge regression on +1 and -1
gives a weight vector for each language; features and weights fold into one matrix, so a batch
of texts is scored by two matrix products.

The model is fitted on at most SAMPLE different texts of each of the LANGUAGES languages with
most rows: those with the smallest hashes. Rows are drawn by comparing a hash of id and text with
a bound for the language, so that no task has to hold a language and repeated rows count once.
Only sets of n-gram numbers (at most SPACE a text) reach the driver, never texts.

Every text is scored whole, however long. Nulls: a null text, or one without a letter, is `und`
with score 0; rows with a null id, text or lang are not learned from. Ties go to the language that
sorts first. Repeated rows get equal results; an empty table gives an empty result. Where no row
can be learned from, every text is `und`. Other columns of df are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SAMPLE = 300
LANGUAGES = 256
LANDMARKS = 64
RIDGE = 1e-2
BATCH = 64
#: Numbers of n-grams.
SPACE = 1 << 18

FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


@lru_cache(1)
def _letters() -> np.ndarray:
    """The lower case of each code point that is a letter, 0 for the others."""
    chars = [chr(c) for c in range(0x110000)]
    return np.fromiter((ord(low) if len(low := c.lower()) == 1 else ord(c) if c.isalpha() else 0 for c in chars), np.uint32, len(chars)) * np.fromiter((c.isalpha() for c in chars), np.uint32, len(chars))


def _number(*points: np.ndarray) -> np.ndarray:
    """Numbers below SPACE of n-grams whose code points the arrays give in order."""
    mixed = np.full(len(points[0]), len(points), np.uint32)
    for p in points:
        mixed = (mixed ^ p) * np.uint32(0x85EBCA6B)
        mixed ^= mixed >> np.uint32(13)
    return (mixed * np.uint32(0xC2B2AE35) >> np.uint32(32 - SPACE.bit_length() + 1)).astype(np.int32)


def grams(text: str | None) -> np.ndarray:
    """Numbers, with repeats, of the n-grams of a text: runs of other characters count as one space."""
    points = _letters()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not len(points) or not points.any():
        return np.empty(0, np.int32)
    stay = points > 0
    stay[1:] |= points[:-1] > 0
    space = np.zeros(1, np.uint32)
    points = np.concatenate((space, points[stay], space))
    return np.concatenate([_number(points[points > 0]), _number(points[:-1], points[1:]), _number(points[:-2], points[1:-1], points[2:])])


class Model:
    """Fitted on sets of n-gram numbers and their languages, in the order in which landmarks are taken."""

    def __init__(self, sets: list[np.ndarray], langs: list[str]) -> None:
        self.langs = sorted(set(langs))
        seen: dict[str, int] = {}
        chosen = []
        each = max(1, LANDMARKS // len(self.langs))
        for i, lang in enumerate(langs):
            if seen.get(lang, 0) < each and len(sets[i]):
                seen[lang] = seen.get(lang, 0) + 1
                chosen.append(i)
        self.grams = np.unique(np.concatenate([sets[i] for i in chosen]))
        self.presence = np.zeros((len(chosen), len(self.grams)), np.float32)
        for row, i in enumerate(chosen):
            self.presence[row, np.searchsorted(self.grams, sets[i])] = 1
        self.sizes = self.presence.sum(axis=1)
        own = self.presence @ self.presence.T / np.sqrt(np.outer(self.sizes, self.sizes))
        value, vector = np.linalg.eigh(own.astype(np.float64))
        root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
        slots = self._slots()
        kernels = np.concatenate([self._kernel(sets[i : i + BATCH], [len(s) for s in sets[i : i + BATCH]], slots) for i in range(0, len(sets), BATCH)])
        features = np.concatenate([kernels @ root, np.ones((len(sets), 1))], axis=1)
        want = np.array([[1.0 if lang == k else -1.0 for k in self.langs] for lang in langs])
        weights = np.linalg.solve(features.T @ features + RIDGE * np.eye(features.shape[1]), features.T @ want)
        self.weights, self.bias = root @ weights[:-1], weights[-1]

    def _slots(self) -> np.ndarray:
        slots = np.full(SPACE, len(self.grams), np.int32)
        slots[self.grams] = np.arange(len(self.grams))
        return slots

    def _kernel(self, found: list[np.ndarray], sizes: list[int], slots: np.ndarray) -> np.ndarray:
        """found: n-gram numbers, repeats allowed; sizes: how many different ones."""
        rows = np.zeros((len(found), len(self.grams) + 1), np.float32)
        for row, own in zip(rows, found, strict=True):
            row[slots[own]] = 1
        return rows[:, :-1] @ self.presence.T / np.sqrt(np.outer(np.maximum(sizes, 1), self.sizes))

    def predictor(self):
        slots, seen = self._slots(), np.zeros(SPACE, bool)

        def size(numbers: np.ndarray) -> int:
            seen[numbers] = True
            count = int(np.count_nonzero(seen))
            seen[numbers] = False
            return count

        def predict(texts: list[str | None]) -> list[list]:
            names: list[str] = []
            scores: list[float] = []
            for i in range(0, len(texts), BATCH):
                found = [grams(t) for t in texts[i : i + BATCH]]
                margin = self._kernel(found, [size(f) for f in found], slots) @ self.weights + self.bias
                best = margin.argmax(axis=1)
                for own, k, m in zip(found, best.tolist(), margin.max(axis=1).tolist(), strict=True):
                    names.append(self.langs[k] if len(own) else "und")
                    scores.append(min(1.0, max(0.0, (m + 1) / 2)) if len(own) else 0.0)
            return [names, scores]

        return predict


def sample(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[np.ndarray], list[str]]:
    """N-gram sets and languages to learn from, in the order of the hashes: at most SAMPLE of each language, none held out."""
    named = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    usable = named.filter("id is not null and text is not null and lang is not null").filter(common.fold("id") != 1)
    usable = usable.withColumn("o", F.xxhash64(F.col("id").cast("string"), "text"))
    sizes = usable.groupBy("lang").agg(F.approx_count_distinct("o").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return [], []
    # hashes are uniform: twice as many as are wanted lie below the bound, and never more than four times as many are taken
    bounds = {r["lang"]: min(int(2 * SAMPLE / r["n"] * (1 << 64)), (1 << 64) - 1) - (1 << 63) for r in sizes}
    bound = F.create_map(*[x for lang, b in bounds.items() for x in (F.lit(lang), F.lit(b).cast("long"))])
    drawn = usable.filter(F.col("o") <= bound[F.col("lang")]).groupBy("lang", "o").agg(F.min("text").alias("text"))
    key = drawn.select(F.struct("lang", "o").alias("k"), "text")
    sets = common.per_text(key, lambda: lambda texts: [[np.unique(grams(t)) for t in texts]], [T.StructField("g", T.ArrayType(T.IntegerType()))], "k", "text")
    rows = sets.select("k.lang", "k.o", "g").limit(4 * SAMPLE * len(bounds)).collect()
    rows.sort(key=lambda r: (r["o"], r["lang"]))
    kept: dict[str, int] = {}
    out = []
    for r in rows:
        kept[r["lang"]] = kept.get(r["lang"], 0) + 1
        if kept[r["lang"]] <= SAMPLE:
            out.append(r)
    return [np.array(r["g"], np.int32) for r in out], [r["lang"] for r in out]


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang_pred, score) of each text; learned from the rows of df that are not held out."""
    sets, langs = sample(df, id_col, text_col, lang_col)
    model = Model(sets, langs) if any(len(s) for s in sets) else None
    factory = (lambda: model.predictor()) if model else (lambda: lambda texts: [["und"] * len(texts), [0.0] * len(texts)])
    return common.per_text(df, factory, FIELDS, id_col, text_col)

"""Quality classifier: regularised quadratic discriminant over statistics of a text.

Each text gives a vector of transformed counts (lengths, shares, repetition, layout). For each
class of labels.quality the mean and the covariance, shrunk towards its diagonal and the pooled
covariance, are fitted on at most SAMPLE different labelled rows that are not held out (those
with the smallest hashes of id and text); only their statistics reach the driver. The score is the
logistic of the difference of the two classes' log densities, from Mahalanobis distances through
Cholesky factors that are computed once. Statistics of one text are no independent Gaussians, so
raw differences are overconfident: they are multiplied by the one of TEMPERS with the least log
loss on a part of the sample that a first fit on the rest has not seen.

Every text is read whole, however long. Nulls: a null text counts as empty and is scored like one;
a null id is scored (with held_out false) but not learned from, as is a null label. A doc_id with
several labels is learned from once for each. Without rows of both classes every score is 0.5.
Repeated rows get equal scores and count once in learning; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SAMPLE = 20_000
SHRINK_DIAGONAL, SHRINK_POOLED = 0.1, 0.1
FLOOR = 1e-3
#: Weights that the difference of log densities can have.
TEMPERS = (1.0, 0.5, 0.25, 0.125, 0.0625)

_CLASS = np.zeros((256, 7), np.int64)
for _b in range(256):
    _CLASS[_b] = [
        (_b & 0xC0) != 0x80, 97 <= _b <= 122, 65 <= _b <= 90, 48 <= _b <= 57, _b in b" \t\n\r\x0b\x0c", _b in b".,;:'\"-?()", _b in b"#*$%&|<>!@^~_=+{}[]\\/",
    ]
_END = re.compile(rb"[.!?][\"')]*$")
N_FEATURES = 14


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, over all of it."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    points, lower, upper, digits, spaces, marks, symbols = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS).tolist()
    words = raw.split()
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = sum(w[-1:] in (b".", b"!", b"?") for w in words)
    solid = max(points - spaces, 1)
    share = lambda k, of: float(np.sqrt(k / of))  # noqa: E731  shares are mostly near 0, where the root spreads them
    return [
        float(np.log1p(len(words))), float(np.log(lengths.mean() + 1)), float(np.log(lengths.std() + 0.1)), float(np.log1p(lengths.max())),
        share(upper, solid), share(digits, solid), share(marks, solid), share(symbols, solid), share(repeats, n), share(n - len(set(words)), n),
        share(ends, n), float(np.log1p(len(words) / max(len(lines), 1))), share(len(lines) - len(set(lines)), max(len(lines), 1)), share(lower, solid),
    ]


class Discriminant:
    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + FLOOR
        z = (x - self.centre) / self.scale
        own = [np.cov(z[y == k].T) if (y == k).sum() > 1 else np.eye(z.shape[1]) for k in (0, 1)]
        share = [(y == k).mean() for k in (0, 1)]
        pooled = share[0] * own[0] + share[1] * own[1]
        self.means = [z[y == k].mean(axis=0) for k in (0, 1)]
        self.factors, self.offsets = [], []
        for k in (0, 1):
            mixed = (1 - SHRINK_POOLED) * own[k] + SHRINK_POOLED * pooled
            mixed = (1 - SHRINK_DIAGONAL) * mixed + SHRINK_DIAGONAL * np.diag(np.diag(mixed)) + FLOOR * np.eye(len(mixed))
            factor = np.linalg.cholesky(mixed)
            self.factors.append(np.linalg.inv(factor))  # triangular; distances are then one product
            self.offsets.append(float(np.log(share[k]) - np.log(np.diag(factor)).sum()))
        self.temper = 1.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        z = (x - self.centre) / self.scale
        log = [self.offsets[k] - 0.5 * (((z - self.means[k]) @ self.factors[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return log[1] - log[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.temper * self.difference(x), -500, 500)))


def _both(y: np.ndarray) -> bool:
    return len(np.unique(y)) == 2


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant | None:
    """The discriminant of all rows; every third row chooses the temper of a fit on the others."""
    if not _both(y):
        return None
    model, aside = Discriminant(x, y), np.arange(len(y)) % 3 == 0
    if _both(y[~aside]) and aside.any():
        d = np.where(y[aside] == 1, 1, -1) * Discriminant(x[~aside], y[~aside]).difference(x[aside])
        model.temper = min(TEMPERS, key=lambda t: np.logaddexp(0, -t * d).mean())
    return model


def train(df: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> Discriminant | None:
    order = F.xxhash64(F.col(id_col).cast("string"))
    chosen = (
        labels.filter(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull() & (common.fold(id_col) != 1))
        .select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("quality"), order.alias("o"))
        .distinct().orderBy("o", "id", "quality").limit(SAMPLE)
    )
    # at most SAMPLE ids are broadcast; an id may stand in any number of rows, so their different texts are drawn again
    named = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.select("id").distinct()), "id", "left_semi")
    named = named.withColumn("th", F.xxhash64("text"))
    drawn = named.select("id", "th").distinct().join(chosen, "id").orderBy("o", "id", "quality", "th").limit(SAMPLE)
    drawn = common.cut(drawn)
    texts = named.join(F.broadcast(drawn.select("id", "th").distinct()), ["id", "th"], "left_semi").groupBy("id", "th").agg(F.min("text").alias("text"))
    keyed = texts.select(F.struct("id", "th").alias("k"), "text")
    found = common.per_text(keyed, lambda: lambda t: [[statistics(x) for x in t]], [T.StructField("v", T.ArrayType(T.DoubleType()))], "k", "text")
    rows = found.select("k.id", "k.th", "v").join(drawn, ["id", "th"]).select("o", "id", "th", "quality", "v").collect()  # at most SAMPLE vectors
    rows.sort(key=lambda r: (r["o"], str(r["id"]), r["th"], r["quality"]))
    return fit(np.array([r["v"] for r in rows]).reshape(-1, N_FEATURES), np.array([r["quality"] for r in rows], np.int64))


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of each text of df; labels: id_col and quality 0 or 1."""
    model = train(df, labels, id_col, text_col)

    def scores(texts: list[str | None]) -> list[list]:
        x = np.array([statistics(t) for t in texts]).reshape(-1, N_FEATURES)
        s = model.score(x) if model else np.full(len(texts), 0.5)
        return [s.tolist(), (s >= 0.5).astype(int).tolist()]

    return common.per_text(df, lambda: scores, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], id_col, text_col)

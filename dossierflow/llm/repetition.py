"""Quality rules: repetition measured on suffix arrays of words.

A batch of texts is one array of word numbers. Suffixes are ranked by prefix doubling
(only groups that are still tied are ranked again), the ranks of all levels give the
longest common prefix of neighbours in suffix order, and from the prefix lengths follow
the maximal repeated substrings of each text, the words that they cover and the longest.

A text is never cut. Ranks take 4 bytes a word for each doubling that still has ties, which is the
base-2 logarithm of the longest repeat in words: a text of ten million words that repeats no
thousand of them needs about 400 MB, and batches of ordinary texts hold 4 MB of text.

Nulls count as texts without words. Ties cannot occur: each text is judged alone, so
repeated rows get equal verdicts. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

#: A repeat counts towards the covered words from this many words on.
MIN_REPEAT = 5
#: A text goes if repeats cover more than this share of its words.
MAX_COVERED = 0.5
#: A text goes if its longest repeat has more words than this and than LONGEST_SHARE of the text.
MAX_LONGEST = 100
LONGEST_SHARE = 0.2
MIN_WORDS = 50

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_WORD_POINT = ~_SPACES & ((np.arange(256) & 0xC0) != 0x80)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("covered_words", T.LongType()),
    T.StructField("longest_repeat", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
]


def longest_repeats(symbols: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position the length of the longest repeated substring of its text that starts there.

    symbols: word numbers; doc: the text of each position, in ascending order.
    """
    n = len(symbols)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    keys = doc.astype(np.int64) * (int(symbols.max()) + 1) + symbols
    order = np.argsort(keys, kind="stable")
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(keys[order[1:]], keys[order[:-1]], out=new[1:])
    # a rank is the place, from 1, of the first suffix of its group in suffix order
    first = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int32 if n < (1 << 31) - 2 else np.int64)
    rank[n] = 0
    rank[order] = first[np.cumsum(new) - 1] + 1
    ends = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) + 1
    end = np.repeat(ends, np.diff(np.concatenate(([0], ends))))
    levels, k = [rank.copy()], 1
    tied = _tied(new)
    while tied.size:
        where = order[tied]
        after = where + k
        second = np.where(after < end[where], rank[np.minimum(after, n)], 0)
        head = rank[where]
        again = np.lexsort((second, head))
        where, head, second = where[again], head[again], second[again]
        order[tied] = where
        fresh = np.empty(len(tied), bool)
        fresh[0] = True
        fresh[1:] = (head[1:] != head[:-1]) | (second[1:] != second[:-1])
        new[tied] = fresh
        place = tied + 1
        ranks = place[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        rank = rank.copy()
        rank[where] = ranks
        levels.append(rank)
        k *= 2
        tied = tied[_tied_within(fresh)]
    # neighbours in suffix order that share a first word
    near = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    a, b = order[near], order[near + 1]
    lcp = np.zeros(len(near), np.int64)
    x, y = a.copy(), b.copy()
    for j in range(len(levels) - 1, -1, -1):
        same = (levels[j][x] == levels[j][y]) & (levels[j][x] > 0) & (doc[np.minimum(x, n - 1)] == doc[a])
        step = np.where(same, 1 << j, 0)
        lcp += step
        x = np.minimum(x + step, n)
        y = np.minimum(y + step, n)
    np.maximum.at(out, a, lcp)
    np.maximum.at(out, b, lcp)
    return out


def _tied(new: np.ndarray) -> np.ndarray:
    return np.flatnonzero(_tied_within(new))


def _tied_within(fresh: np.ndarray) -> np.ndarray:
    """True where the group that a fresh flag opens has more than one member."""
    alone = fresh & np.append(fresh[1:], True)
    return ~alone


def covered(length: np.ndarray, least: int, spans: int | None = None) -> np.ndarray:
    """True for positions inside a repeat of at least `least` words (or of just `spans` words from its start).

    Only repeats that cannot be extended to the left are drawn; the others lie within them.
    """
    n = len(length)
    starts = length >= least
    if spans is None:
        starts[1:] &= length[:-1] != length[1:] + 1
    where = np.flatnonzero(starts)
    change = np.zeros(n + 1, np.int64)
    change[where] += 1
    np.add.at(change, where + (length[where] if spans is None else spans), -1)
    return np.cumsum(change[:n]) > 0


def measure(texts: list[str | None]) -> list[list]:
    number: dict[bytes, int] = {}
    ids: list[int] = []
    counts, points, symbols, dup_lines = [], [], [], []
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.split()
        ids.extend([number.setdefault(w, len(number)) for w in words])
        counts.append(len(words))
        seen_bytes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        points.append(int(seen_bytes[_WORD_POINT].sum()))
        symbols.append(int(seen_bytes[_SYMBOL].sum()))
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        dup_lines.append(len(lines) - len(set(lines)))
    n_words = np.array(counts, np.int64)
    doc = np.repeat(np.arange(len(texts)), n_words)
    length = longest_repeats(np.array(ids, np.int64), doc)
    total = lambda flags: np.bincount(doc[flags], minlength=len(texts)).astype(np.int64)
    repeat_words = total(covered(length, 3, 3))
    cover = total(covered(length, MIN_REPEAT))
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc, length)
    failed = (n_words < MIN_WORDS) | (100 * repeat_words > 50 * n_words)
    over = (cover > MAX_COVERED * n_words) | ((longest > MAX_LONGEST) & (longest > LONGEST_SHARE * n_words))
    return [n_words.tolist(), points, symbols, dup_lines, repeat_words.tolist(), cover.tolist(), longest.tolist(), failed.tolist(), (~failed & ~over).tolist()]


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict of each text: base counts, words covered by maximal repeats, longest repeat, kept.

    A null or empty text has no words, fails the base rule and is not kept.
    """
    return common.per_text(df, lambda: measure, FIELDS, id_col, text_col)


def keep(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df whose text the rules keep, all columns unchanged; one pass, nothing is shuffled."""
    at = df.columns.index(text_col)

    def run(batches):
        for batch in common.slices(batches, at):
            yield batch.filter(pa.array(measure(batch.column(at).to_pylist())[-1], pa.bool_()))

    return df.mapInArrow(run, df.schema)

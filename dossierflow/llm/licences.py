"""Licence scans: matching statistics of a text against licence templates.

A generalised suffix automaton holds every run of words of every template. A text streams
through it word by word; the automaton gives, at each word, the longest run of words that ends
there and that some template has. Long runs are chained, in the order of both text and template,
into covered template spans; of runs that overlap, the later one counts from where the earlier one
ends. A template whose words are covered to a sufficient share yields its label. Words that no
template has reset the automaton, so stretches of fewer than LEAST known words cannot hold a run
and are passed over.

Nulls and empty texts have no words, no labels and score 0. A very long text is read whole; a run is
compared with those before it within the length of its template. Equal chains go to the one that
starts first; each template gives its own label. Repeated rows get equal results; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common
from .licence_texts import TEMPLATES

#: Phrases of the base scan and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Shortest run of words that counts, widest gap in a chain, and share of a template that gives its label.
LEAST, GAP, SHARE = 3, 12, 0.75

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.StringType()),
]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over word numbers; each state knows where its words end in the templates."""

    def __init__(self, templates: dict[str, list[str]]) -> None:
        self.labels: list[str] = []
        self.lengths: list[int] = []
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for label in sorted(templates):
            for text in templates[label]:
                symbols = [self.number.setdefault(w, len(self.number)) for w in words_of(text)]
                last = 0
                for place, symbol in enumerate(symbols):
                    last = self._extend(last, symbol)
                    self.ends[last].add((len(self.labels), place))
                self.labels.append(label)
                self.lengths.append(len(symbols))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _clone(self, p: int, q: int, symbol: int) -> int:
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, symbol: int) -> int:
        if (q := self.next[last].get(symbol)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, symbol)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, symbol)
        return new

    def matches(self, symbols: list[int], offset: int) -> list[tuple[int, int, int]]:
        """(start, length, state) of runs of at least LEAST words that the next word does not prolong."""
        found, state, held = [], 0, 0
        for i, symbol in enumerate(symbols):
            step = self.next[state].get(symbol)
            if step is None and held >= LEAST:
                found.append((offset + i - held, held, state))
            while step is None and state:
                state = self.link[state]
                held = self.length[state]
                step = self.next[state].get(symbol)
            if step is not None:
                state, held = step, held + 1
        if held >= LEAST:
            found.append((offset + len(symbols) - held, held, state))
        return found

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[float, int, int, int]]:
        """(share, template, start, end): the chains of runs of each template, best share of words covered."""
        runs: dict[int, list[tuple[int, int, int]]] = {}
        for start, held, state in matches:
            for template, end in self.ends[state]:
                runs.setdefault(template, []).append((start, end - held + 1, held))
        out = []
        for template, own in runs.items():
            best: list[tuple[int, int]] = []  # covered words, start in the text
            own.sort()
            for i, (s, t, n) in enumerate(own):
                top = (n, s)
                for j in range(i - 1, -1, -1):
                    ps, pt, pn = own[j]
                    if s - ps > GAP + max(self.lengths[template], pn):
                        break
                    shared = max(0, ps + pn - s, pt + pn - t)
                    if s - (ps + pn) <= GAP and s > ps and t > pt and shared < n:
                        top = max(top, (best[j][0] + n - shared, best[j][1]), key=lambda x: x[0])
                best.append(top)
            out += [(c / self.lengths[template], template, s, own[i][0] + own[i][2]) for i, (c, s) in enumerate(best)]
        return out


def scanner(templates: dict[str, list[str]] = TEMPLATES):
    automaton = Automaton(templates)
    phrases = [(f" {p} ".encode(), label) for p, label in PHRASES.items()]
    unknown = -1

    def scan(text: str | None) -> tuple:
        words = words_of(text)
        places: list[int] = []
        base: set[str] = set()
        line = b" %b " % b" ".join(words)
        for phrase, label in phrases:
            at, counted, place = line.find(phrase), 0, 0
            while at >= 0:
                place += line.count(b" ", counted, at)
                counted = at
                places.append(place)
                base.add(label)
                at = line.find(phrase, at + 1)
        ids = np.array([automaton.number.get(w, unknown) for w in words], np.int64)
        known = np.concatenate(([0], (ids >= 0).astype(np.int8), [0]))
        edge = np.diff(known)
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = stops - starts >= LEAST
        matches = [m for s, e in zip(starts[long].tolist(), stops[long].tolist(), strict=True) for m in automaton.matches(ids[s:e].tolist(), s)]
        chains = automaton.chains(matches)
        labels, spans = set(base), set()
        for share, template, start, end in chains:
            if share >= SHARE:
                labels.add(automaton.labels[template])
                spans.add((automaton.labels[template], start, end))
        score = 1.0 if base else min(1.0, max((c[0] for c in chains), default=0.0))
        return (
            len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score,
            ",".join(f"{label}:{s}:{e}" for label, s, e in sorted(spans)),
        )

    return lambda texts: [list(c) for c in zip(*map(scan, texts), strict=True)]


def licence_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """Word count, base phrases, labels, score and covered spans (label:first word:word after the last) of each text."""
    return common.per_text(df, lambda: scanner(templates), FIELDS, id_col, text_col)

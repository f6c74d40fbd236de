"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions.

The model is trained in numpy on labelled spans that a seeded generator writes into invented
sentences: addresses, numbers and their obfuscated forms, and look-alikes that are none. It
reads classes of characters, so it does not depend on the words around a span. `python -m
dossierflow.llm.pii` trains it again and writes WEIGHTS beside this file, which queries read.

A span always holds an anchor (a digit, an at-sign, or "at" in brackets), so only stretches
around anchors are cut into overlapping windows and decoded with Viterbi. A span whose first or
last word a window's edge cuts is left to a window that has it whole. Where none has, because the span is
longer than the overlap, that stretch is decoded again with windows twice as long, and again, up
to the whole text: no length of span is out of reach. The spans of all windows of a text are
reconciled globally: those that overlap compete by weighted interval scheduling, with the number
of characters times the windows that agree as weight. A span of the model is kept if its numbers
can be such data (octets, Luhn, counts of digits) and no base span overlaps it; base spans stay.

Nulls: a null text has no spans. Very long texts are read whole, in windows. Repeated rows get
equal spans; an empty table an empty result.
"""

from __future__ import annotations

import hashlib
import os
import random
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

KINDS = ("email", "ip", "card", "phone")
WINDOW, OVERLAP = 96, 64
HIDDEN, EMBED = 20, 10
EPOCHS, BATCH, RATE = 16, 32, 0.015
#: Sentences to learn from: length, how many.
EXAMPLES = ((WINDOW, 4000), (4 * WINDOW, 480))
SEED = 7
WEIGHTS = os.path.join(os.path.dirname(__file__), "pii_weights.npz")

Span = tuple[str, int, int]

# --- base patterns -------------------------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MAYBE = re.compile(r"[0-9@]")


def _emails(text: str) -> list[Span]:
    """Leftmost matches of local@domain, one look at each at-sign."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            done = found.end()
        else:
            # what stands before this at-sign can be in no later match, which would have to hold it
            done = at + 1
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind as listed, then start."""
    if not _MAYBE.search(text):
        return []
    out = _emails(text)
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := q.lstrip("0")) <= 3 and int(p or 0) <= 255 for q in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# --- characters and labels -----------------------------------------------------------------

_MARKS = "@.-+()[] ,:;/_\"'\n=#*$%&|<>!?"
_N_CLASSES = 8 + len(_MARKS)
_CLASSES = np.zeros(256, np.int64)
for _c in range(256):
    _s = chr(_c)
    _CLASSES[_c] = 1 if _s.isdigit() and _c < 128 else 2 if _s.islower() else 3 if _s.isupper() else 8 + _MARKS.index(_s) if _s in _MARKS else 4
for _k, _s in enumerate("at"):
    _CLASSES[ord(_s)] = 5 + _k
_PAD = 0
_TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
_N = len(_TAGS)
_ALLOWED = np.array([[not b.startswith("I") or a[2:] == b[2:] for b in _TAGS] for a in _TAGS])


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 256, _CLASSES[np.minimum(points, 255)], 7)


def example(r: random.Random, size: int = WINDOW) -> tuple[str, np.ndarray]:
    """One invented sentence of the given size and its tags; a longer one has long names in it."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    longest = 10 if size <= WINDOW else size // 2
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(letters + "aeiouaeioué") for _ in range(r.randint(1, 10)))
    name = lambda: "".join(r.choice(letters) for _ in range(r.randint(2, 10 if r.random() < 0.5 else longest)))
    octet = lambda: str(r.randint(0, 255))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    end = lambda: r.choice(["com", "org", "net", "de"])

    def card(sep: str) -> str:
        d = num(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def hidden() -> str:
        at, dot = r.choice([" [at] ", " (at) ", "[at]", "(at)"]), r.choice([".", " [dot] ", " (dot) "])
        return f"{name()}{r.choice(['', '.' + word(), num(2)])}{at}{name()}{r.choice(['', num(1)])}{dot}{end()}"

    spans = {
        "email": lambda: r.choice([hidden, hidden, lambda: f"{name()}.{num(2)}@{word()}{num(1)}.example.com", lambda: f"{name()}@{name()}.{end()}", lambda: f"{name()} @ {name()}.{end()}"])(),
        "ip": lambda: r.choice([".", "[.]", "(.)", "[.]", "(.)"]).join(octet() for _ in range(4)),
        "card": lambda: card(r.choice(["", " ", "-", ".", "  ", ".", "  "])),
        "phone": lambda: r.choice([
            lambda: f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"+{num(2)} {num(3)} {num(7)}", lambda: f"{num(3)}-{num(3)}-{num(4)}",
            lambda: f"00{num(2)} {num(3)} {num(6)}", lambda: f"+{num(2)}/{num(3)}/{num(6)}", lambda: f"{num(3)}.{num(3)}.{num(4)}",
        ])(),
    }
    decoys = [
        lambda: f"{r.randint(1900, 2100)}", lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}", lambda: f"{r.randint(1990, 2030)}-0{r.randint(1, 9)}-{r.randint(10, 28)}",
        lambda: f"{num(1)}.{num(1)}", lambda: f"version {num(1)}.{num(2)}.{num(1)}", lambda: f"${num(3)},{num(3)}.{num(2)}", lambda: f"token = \"{hexa(32)}\"", lambda: f"password={hexa(18)}",
        lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)), lambda: f"CC BY-NC {num(1)}.{num(1)}.", lambda: num(r.randint(2, 6)), lambda: f"@{word()}",
        lambda: hexa(40), lambda: f"p. {num(2)}-{num(2)}", lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: f"{num(1)} {num(1)} {num(1)}", lambda: f"{word()} at {word()}", lambda: f"{num(20)}{num(4)}",
        lambda: f"({num(4)})", lambda: f"[{num(1)}], [{num(2)}]", lambda: f"{num(2)}%", lambda: f"# {num(3)}", lambda: f"a({num(1)})", lambda: name(), lambda: f"{word()} (at {word()}) {word()}.",
    ]
    text, tags = "", []

    def put(s: str, kind: str | None = None) -> None:
        nonlocal text
        text += s
        tags.extend([0] * len(s) if kind is None else [_TAGS.index(f"B-{kind}")] + [_TAGS.index(f"I-{kind}")] * (len(s) - 1))

    put(" ".join(word() for _ in range(r.randint(0, 4))) + r.choice(["", " ", ", ", ". ", "\n", " (", ": "]))
    if text and text[-1].isalpha():
        put(" ")
    while len(text) < size:
        if r.random() < 0.42:
            kind = r.choice(KINDS)
            put(spans[kind](), kind)
        elif r.random() < 0.6:
            put(r.choice(decoys)())
        else:
            put(" ".join(word().capitalize() if r.random() < 0.2 else word() for _ in range(r.randint(1, 6))))
        put(r.choice([". ", ", ", "; ", "\n", ") ", " - "]) if r.random() < 0.5 else f" {word()} ")
    return text[:size], np.array(tags[:size])


# --- the network ---------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(table: np.ndarray, u: np.ndarray, x: np.ndarray, keep: list | None = None, project: np.ndarray | None = None) -> np.ndarray:
    """Hidden states (time, batch, HIDDEN), or their products with project.

    table: gate inputs of each class (bias included); x: classes (time, batch).
    """
    steps, n = x.shape
    h, c = np.zeros((n, HIDDEN), table.dtype), np.zeros((n, HIDDEN), table.dtype)
    out = np.empty((steps, n, HIDDEN if project is None else project.shape[1]), table.dtype)
    for t in range(steps):
        g = table[x[t]] + h @ u
        s = _sigmoid(g[:, : 3 * HIDDEN])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        z = np.tanh(g[:, 3 * HIDDEN :])
        before, c = c, f * c + i * z
        w = np.tanh(c)
        if keep is not None:
            keep.append((h, before, i, f, o, z, w))
        h = o * w
        out[t] = h if project is None else h @ project
    return out


def _lstm_back(u: np.ndarray, kept: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient of the gate inputs (time, batch, 4 * HIDDEN), gradient of u)."""
    steps, n, _ = grad.shape
    du, dg = np.zeros_like(u), np.empty((steps, n, 4 * HIDDEN))
    dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, z, w = kept[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - w * w)
        dg[t] = np.concatenate([dc * z * i * (1 - i), dc * c * f * (1 - f), dh * w * o * (1 - o), dc * i * (1 - z * z)], axis=1)
        du += h.T @ dg[t]
        dh, dc = dg[t] @ u.T, dc * f
    return dg, du


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Embedding, two LSTMs and a linear layer give scores of tags; a CRF scores their sequence."""

    def __init__(self) -> None:
        g = np.random.default_rng(SEED)
        self.p = {
            "emb": g.normal(0, 0.5, (_N_CLASSES, EMBED)), "out": g.normal(0, 0.3, (2 * HIDDEN, _N)), "bias": np.zeros(_N), "move": np.zeros((_N, _N)),
        }
        for side in "fb":
            self.p |= {f"w{side}": g.normal(0, 0.3, (EMBED, 4 * HIDDEN)), f"u{side}": g.normal(0, 0.3, (HIDDEN, 4 * HIDDEN)), f"b{side}": np.zeros(4 * HIDDEN)}
            self.p[f"b{side}"][HIDDEN : 2 * HIDDEN] = 1

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, steps, n = self.p, *x.shape
        kept: dict[str, list] = {"f": [], "b": []}
        tables = {s: p["emb"] @ p[f"w{s}"] + p[f"b{s}"] for s in "fb"}
        forward = _lstm(tables["f"], p["uf"], x, kept["f"])
        backward = _lstm(tables["b"], p["ub"], x[::-1], kept["b"])[::-1]
        both = np.concatenate([forward, backward], axis=2)
        scores = both @ p["out"] + p["bias"]
        move = np.where(_ALLOWED, p["move"], -1e4)
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = scores[0]
        for t in range(1, steps):
            alpha[t] = _log_sum(alpha[t - 1][:, :, None] + move, 1) + scores[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = _log_sum(move + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
        total = _log_sum(alpha[-1], 1)
        ds = np.exp(alpha + beta - total[:, None])
        pair = np.exp(alpha[:-1][:, :, :, None] + move + (scores[1:] + beta[1:])[:, :, None, :] - total[:, None, None])
        dmove = pair.sum(axis=(0, 1))
        np.subtract.at(ds, (np.arange(steps)[:, None], np.arange(n), y), 1)
        np.subtract.at(dmove, (y[:-1], y[1:]), 1)
        grad = {"move": np.where(_ALLOWED, dmove, 0), "out": both.reshape(-1, 2 * HIDDEN).T @ ds.reshape(-1, _N), "bias": ds.sum(axis=(0, 1)), "emb": np.zeros_like(p["emb"])}
        db = ds @ p["out"].T
        for s, own, part in (("f", x, db[:, :, :HIDDEN]), ("b", x[::-1], db[::-1, :, HIDDEN:])):
            dg, grad[f"u{s}"] = _lstm_back(p[f"u{s}"], kept[s], part)
            by_class = np.zeros_like(tables[s])
            np.add.at(by_class, own.ravel(), dg.reshape(-1, 4 * HIDDEN))
            grad[f"w{s}"], grad[f"b{s}"] = p["emb"].T @ by_class, by_class.sum(axis=0)
            grad["emb"] += by_class @ p[f"w{s}"].T
        return {k: v / n for k, v in grad.items()}

    def train(self, made: list[tuple[str, np.ndarray]]) -> None:
        """Adam over batches of sentences of one length."""
        by_size: dict[int, list[int]] = {}
        for i, (text, _) in enumerate(made):
            by_size.setdefault(len(text), []).append(i)
        coded = [classes(text) for text, _ in made]
        order, step = np.random.default_rng(SEED), 0
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS) + 5e-4
            batches = [mixed[i : i + BATCH] for own in by_size.values() for mixed in [order.permutation(own)] for i in range(0, len(own), BATCH)]
            for b in order.permutation(len(batches)):
                step += 1
                some = batches[b]
                x, y = np.stack([coded[i] for i in some]).T, np.stack([made[i][1] for i in some]).T
                for k, g in self._gradients(x, y).items():
                    g = np.clip(g, -5, 5)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)

    def frozen(self) -> dict[str, np.ndarray]:
        p = self.p
        tables = {f"t{s}": p["emb"] @ p[f"w{s}"] + p[f"b{s}"] for s in "fb"}
        rest = {k: p[k] for k in ("uf", "ub", "out", "bias")}
        return {k: v.astype(np.float32) for k, v in (tables | rest | {"move": np.where(_ALLOWED, p["move"], -1e4)}).items()}


def fitted() -> dict[str, np.ndarray]:
    """A model trained from nothing on the generator's sentences."""
    r = random.Random(SEED)
    tagger = Tagger()
    tagger.train([example(r, size) for size, count in EXAMPLES for _ in range(count)])
    return tagger.frozen()


@lru_cache(1)
def trained() -> dict[str, np.ndarray]:
    """The fitted weights that stand beside this file."""
    with np.load(WEIGHTS) as held:
        return {k: held[k] for k in held.files}


def decode(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Viterbi tags (time, batch) of classes (time, batch)."""
    scores = _lstm(model["tf"], model["uf"], x, project=model["out"][:HIDDEN])
    scores += _lstm(model["tb"], model["ub"], x[::-1], project=model["out"][HIDDEN:])[::-1]
    scores += model["bias"]
    steps, n, _ = scores.shape
    back = np.empty((steps, n, _N), np.int8)
    best = scores[0] + np.where([t.startswith("I") for t in _TAGS], -1e4, 0).astype(np.float32)
    for t in range(1, steps):
        way = best[:, :, None] + model["move"]
        back[t] = way.argmax(axis=1)
        best = way.max(axis=1) + scores[t]
    tags = np.empty((steps, n), np.int64)
    tags[-1] = best.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        tags[t - 1] = back[t][np.arange(n), tags[t]]
    return tags


# --- windows and reconciliation ------------------------------------------------------------

_ANCHOR = re.compile(r"[0-9@]|[\[(] ?at ?[\])]")


def windows(text: str, window: int = WINDOW, within: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Overlapping windows over the stretches around anchors (only those that meet one of the spans in within)."""
    overlap = window * OVERLAP // WINDOW
    stretches: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        a, b = max(0, m.start() - overlap), min(len(text), m.end() + overlap)
        if stretches and a <= stretches[-1][1]:
            stretches[-1][1] = b
        else:
            stretches.append([a, b])
    if within is not None:
        stretches = [s for s in stretches if any(s[0] <= b and a <= s[1] for a, b in within)]
    out = []
    for a, b in stretches:
        while True:
            out.append((a, min(a + window, b)))
            if a + window >= b:
                break
            a += window - overlap
    return out


def _sensible(kind: str, s: str) -> bool:
    """Whether the numbers in a span can be such data; its shape is the model's to judge."""
    d = _digits(s)
    if kind == "email":
        return len(re.findall(r"\w+", s)) >= 3 and bool(_ANCHOR.search(s))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and len(set(d)) > 1
    return 9 <= len(d) <= 15


def reconciled(text: str, found: list[Span], base: list[Span]) -> list[Span]:
    """The model's spans of one text: best set without overlaps, apart from base spans."""
    votes: dict[Span, int] = {}
    for s in found:
        votes[s] = votes.get(s, 0) + 1
    taken = sorted((a, b) for _, a, b in base)  # of different kinds, so they may overlap each other
    ends = list(accumulate((b for _, b in taken), max))
    starts = [a for a, _ in taken]

    def clear(s: Span) -> bool:
        before = bisect_left(starts, s[2])  # base spans that start before this one ends
        return not before or ends[before - 1] <= s[1]

    free = sorted((s for s in votes if clear(s) and _sensible(s[0], text[s[1] : s[2]])), key=lambda s: (s[2], s[1], KINDS.index(s[0])))
    worth, last, use = [0], [s[2] for s in free], []  # worth[i]: of the best set among the first i
    for i, s in enumerate(free):
        j = bisect_right(last, s[1], 0, i)
        value = worth[j] + (s[2] - s[1]) * votes[s]
        use.append(j if value > worth[i] else -1)
        worth.append(max(value, worth[i]))
    out, i = [], len(free)
    while i:
        if use[i - 1] >= 0:
            out.append(free[i - 1])
            i = use[i - 1]
        else:
            i -= 1
    return out[::-1]


def _one_word(text: str, a: int, b: int) -> bool:
    return len(text[a:b].split()) == 1 and not text[a].isspace() and not text[b - 1].isspace()


def _tagged(model: dict[str, np.ndarray], texts: list[str | None], where: list[tuple[int, int, int]], window: int) -> tuple[list[list[Span]], list[list[Span]]]:
    """For each text the spans that a window has whole, and those that a cut edge ends."""
    whole: list[list[Span]] = [[] for _ in texts]
    cut: list[list[Span]] = [[] for _ in texts]
    coded: dict[int, np.ndarray] = {}
    batch = max(1, 1024 * WINDOW // window)
    for i in range(0, len(where), batch):
        part = where[i : i + batch]
        x = np.full((window, len(part)), _PAD, np.int64)
        for column, (k, a, b) in enumerate(part):
            if k not in coded:
                coded = {k: classes(texts[k])}
            x[: b - a, column] = coded[k][a:b]
        tags = decode(model, x).T
        for (k, a, b), row in zip(part, tags, strict=True):
            for begin in np.flatnonzero(row[: b - a] % 2 == 1).tolist():
                end = begin + 1
                while end < b - a and row[end] == row[begin] + 1:
                    end += 1
                open_edge = (a > 0 and _one_word(texts[k], a - 1, a + begin + 1)) or (b < len(texts[k]) and _one_word(texts[k], a + end - 1, b + 1))
                (cut if open_edge else whole)[k].append((KINDS[row[begin] // 2], a + begin, a + end))
    return whole, cut


def finder(model: dict[str, np.ndarray]):
    """A function from texts to (base spans, all spans) of each."""

    def run(texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
        found: list[list[Span]] = [[] for _ in texts]
        where, window = [(k, a, b) for k, t in enumerate(texts) if t for a, b in windows(t)], WINDOW
        while where:
            whole, cut = _tagged(model, texts, where, window)
            where, window = [], 2 * window
            for k, own in enumerate(whole):
                found[k] += own
                # a cut span that some window has whole needs no longer window
                long = [(a, b) for kind, a, b in cut[k] if not any(s[0] == kind and s[1] <= a and b <= s[2] for s in own)] if cut[k] else []
                if long:
                    where += [(k, a, b) for a, b in windows(texts[k], window, long)]
        out = []
        for text, more in zip(texts, found, strict=True):
            base = base_spans(text or "")
            own = reconciled(text, more, base) if more else []
            out.append((base, sorted(base + own, key=lambda s: (KINDS.index(s[0]), s[1]))))
        return out

    return run


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FIELDS = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, digest of the base spans, and all spans (kind:start:end) of each text.

    n_<kind> and base_sha256 are of the base patterns; spans also holds the model's.
    """
    model = trained()

    def factory():
        run = finder(model)

        def columns(texts: list[str | None]) -> list[list]:
            rows = run(texts)
            counts = [[sum(s[0] == k for s in base) for base, _ in rows] for k in KINDS]
            return [*counts, [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in rows], [written(every) for _, every in rows]]

        return columns

    return common.per_text(df, factory, FIELDS, id_col, text_col)


def mask(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with each span of text_col replaced by its kind in angle brackets (a null text stays null)."""
    model = trained()

    def run(batches):
        import pyarrow as pa

        find_in = finder(model)
        for batch in common.slices(batches, at):
            texts = batch.column(at).to_pylist()
            out = []
            for text, (_, spans) in zip(texts, find_in(texts), strict=True):
                done, parts = 0, []
                for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                    if a >= done:
                        parts += [text[done:a], f"<{kind.upper()}>"]
                    elif b <= done:
                        continue
                    done = max(done, b)
                out.append(text if text is None or not parts else "".join(parts) + text[done:])
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    at = df.columns.index(text_col)
    return df.mapInArrow(run, df.schema)


def main() -> None:
    np.savez_compressed(WEIGHTS, **fitted())


if __name__ == "__main__":
    main()

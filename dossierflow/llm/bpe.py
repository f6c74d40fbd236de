"""BPE encoding and decoding by batched numpy merge rounds.

The words of a batch that are new to the task become one flat array of symbols. In each round
every adjacent pair within a word is looked up by binary search over the sorted pair keys; in
each word the pair of lowest rank is merged (all its places from the left, or only the first
where the merged symbol is also part of a pair of lower rank, so that the order of merges is
that of one-at-a-time merging). Encoded words are kept for the rest of the task, up to a bound.

Rounds cost the length of a word times their number. A word of more than LONG bytes (a stretch
without spaces, such as Han or base64) would make that a square, so its pairs go through a heap
ordered by rank and place: near linear, the same merges in the same order.

The vocabulary is a tokenizer file of the installed library (a parameter, read on the driver
and sent along). Its normaliser (NFC, lower case), its split pattern, its word suffix and its
special tokens are followed; truncation and padding are not used. A null text encodes as an
empty one. Repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

#: Words that a task keeps encoded, and bytes that they may have in all.
KEPT, KEPT_BYTES = 600_000, 128_000_000
#: Longer words (bytes) are merged with a heap.
LONG = 512
BATCH_WORDS = 50_000

FIELDS = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


@lru_cache(1)
def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


def symbols_at(symbols: list[int], places: np.ndarray) -> list[int]:
    return [symbols[i] for i in places.tolist()]


class Tokenizer:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        steps = spec["normalizer"]["normalizers"]
        self.lower = any(s["type"] == "Lowercase" for s in steps)
        self.pattern = next(s["pattern"]["Regex"] for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.size = max(*vocab.values(), *self.special.values()) + 1
        self.names: list[str] = [""] * self.size
        for name, k in [*vocab.items(), *self.special.items()]:
            self.names[k] = name
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters])
        self.final = np.array([vocab[c + suffix] for c in letters])
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * self.size + right
        keys, first = np.unique(keys, return_index=True)  # a pair that is listed twice has its first rank
        self.keys, self.rank, self.made = keys, first.astype(np.int64), made[first]
        lowest = np.full(self.size, len(merges) + 1, np.int64)  # lowest rank of a pair that has the symbol
        np.minimum.at(lowest, left, np.arange(len(merges)))
        np.minimum.at(lowest, right, np.arange(len(merges)))
        self.at_once = lowest[self.made] > self.rank

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Token ids of each word (not empty)."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        short = [i for i, r in enumerate(raw) if len(r) <= LONG]
        out = [np.empty(0, np.int64) if len(r) <= LONG else self._encode_long(r) for r in raw]
        for i, ids in zip(short, self._encode_short([raw[i] for i in short]), strict=True):
            out[i] = ids
        return out

    def _encode_long(self, raw: bytes) -> np.ndarray:
        """One word by a heap of (rank, place) over a chain of symbols; entries whose symbols have changed are passed over."""
        start = self.inner[np.frombuffer(raw, np.uint8)]
        start[-1] = self.final[raw[-1]]
        pair = start[:-1] * self.size + start[1:]
        place = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        known = np.flatnonzero(self.keys[place] == pair)
        symbols, n = start.tolist(), len(start)
        heap = list(zip(self.rank[place[known]].tolist(), known.tolist(), symbols_at(symbols, known), symbols_at(symbols, known + 1), self.made[place[known]].tolist(), strict=True))
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        seen: dict[int, tuple[int, int] | None] = {}

        def offer(i: int, j: int) -> None:
            key = symbols[i] * self.size + symbols[j]
            if key not in seen:
                at = int(np.searchsorted(self.keys, key))
                seen[key] = (int(self.rank[at]), int(self.made[at])) if at < len(self.keys) and self.keys[at] == key else None
            if found := seen[key]:
                heapq.heappush(heap, (found[0], i, symbols[i], symbols[j], found[1]))

        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return np.array([x for x in symbols if x >= 0], np.int64)

    def _encode_short(self, raw: list[bytes]) -> list[np.ndarray]:
        words = raw
        if not raw:
            return []
        flat = np.frombuffer(b"".join(raw), np.uint8)
        lengths = np.array([len(r) for r in raw])
        word = np.repeat(np.arange(len(words)), lengths)
        symbols = self.inner[flat]
        last = np.cumsum(lengths) - 1
        symbols[last] = self.final[flat[last]]
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        nothing = len(self.keys) and np.iinfo(np.int64).max
        while len(symbols):
            pair = symbols[:-1] * self.size + symbols[1:]
            place = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            found = (self.keys[place] == pair) & (word[1:] == word[:-1])
            rank = np.append(np.where(found, self.rank[place], nothing), nothing)
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.append(heads, len(symbols)))
            done = least == nothing
            if done.any():
                for h, s in zip(heads[done].tolist(), sizes[done].tolist(), strict=True):
                    out[word[h]] = symbols[h : h + s]
                stay = np.repeat(~done, sizes)
                symbols, word, rank = symbols[stay], word[stay], rank[stay]
                place = np.append(place, 0)[stay]
                least, sizes = least[~done], sizes[~done]
                if not len(symbols):
                    break
            else:
                place = np.append(place, 0)
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            # of places that follow each other (one symbol several times), every second
            run = np.append(True, np.diff(hit) != 1)
            hit = hit[(hit - np.repeat(hit[run], np.diff(np.append(np.flatnonzero(run), len(hit))))) % 2 == 0]
            first = np.append(True, word[hit[1:]] != word[hit[:-1]])
            hit = hit[first | self.at_once[place[hit]]]
            symbols[hit] = self.made[place[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, word = symbols[keep], word[keep]
        return out

    def splitter(self):
        """A function from a stretch without white space to its parts: words, or ids of special tokens."""
        pattern, newer = regex.compile(self.pattern), _newer()
        other = r"[^\s\p{L}\p{N}]"
        changed = self.pattern.replace(other, "\0").replace(r"\p{L}", rf"\p{{L}}--[{newer}]").replace(r"\p{N}", rf"\p{{N}}--[{newer}]")
        older = regex.compile(changed.replace("\0", f"(?:[{newer}]|{other})"), regex.V1)
        fresh = regex.compile(f"[{newer}]")
        special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

        def plain(text: str) -> list[str]:
            if text.isascii():
                return pattern.findall(text.lower() if self.lower else text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if self.lower:
                text = text.translate(LOWER)
            return (older if fresh.search(text) else pattern).findall(text.lower() if self.lower else text)

        first = {s[0] for s in self.special}

        def split(text: str) -> list[str | int]:
            if first.isdisjoint(text) or not special.search(text):
                return plain(text)
            parts, at = [], 0
            for m in special.finditer(text):
                parts += [*plain(text[at : m.start()]), self.special[m[0]]]
                at = m.end()
            return parts + plain(text[at:])

        return split


#: Ranges of letters and numbers that Unicode 16 added; the tokenizer's split pattern has them.
UNICODE_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x113E2),
    (0x116D0, 0x116E3), (0x11BC0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x16139), (0x16D40, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FA),
]


#: Lower case of the upper-case letters that Unicode 16 and 17 added.
LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}


@lru_cache(1)
def _newer() -> str:
    """A character class of the letters and numbers of newer Unicode versions than the tokenizer's."""
    both = regex.compile(r"[\p{L}\p{N}]")
    known = {c for a, b in UNICODE_16 for c in range(a, b + 1)}
    points = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn" and c not in known and both.match(chr(c))]
    ranges: list[list[int]] = []
    for c in points:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) or "\\U0010ffff"


def stretches(text: str) -> list[str]:
    """What lies between white space; the four separators U+001C to U+001F are no white space to the tokenizer."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [x for x in regex.split(r"[\s--[\x1c-\x1f]]+", text, flags=regex.V1) if x]
    return text.split()


def encoder(tokenizer: Tokenizer, digest: bool = False):
    """A function from texts to lists of ids and decoded texts, or to counts and digests of both.

    No word reaches over white space, so texts are looked up by the stretches between it.
    """
    split = tokenizer.splitter()
    digits, names = [str(k).encode() for k in range(tokenizer.size)], [n.encode("utf-8") for n in tokenizer.names]
    known: dict[str, tuple[int, bytes, bytes]] = {}
    parts_known: dict[str | int, tuple[int, bytes, bytes]] = {}
    held = 0

    def told(ids: list[int]) -> tuple[int, bytes, bytes]:
        return len(ids), b" ".join([digits[k] for k in ids]), b" ".join([names[k] for k in ids])

    def learn(stretches: set[str]) -> None:
        nonlocal held
        if len(known) + len(stretches) > KEPT or held > KEPT_BYTES:
            known.clear()
            parts_known.clear()
            held = 0
        new = [w for w in stretches if w not in known]
        for i in range(0, len(new), BATCH_WORDS):
            some = new[i : i + BATCH_WORDS]
            parts = [split(w) for w in some]
            fresh = {x for p in parts for x in p}.difference(parts_known)
            words = [x for x in fresh if isinstance(x, str)]
            for x, ids in zip(words, tokenizer.encode_words(words), strict=True):
                parts_known[x] = told(ids.tolist())
            for x in fresh.difference(words):
                parts_known[x] = told([x])
            for w, p in zip(some, parts, strict=True):
                if len(p) == 1:
                    known[w] = parts_known[p[0]]
                else:
                    own = [parts_known[x] for x in p]
                    known[w] = (sum([o[0] for o in own]), b" ".join([o[1] for o in own]), b" ".join([o[2] for o in own]))
                held += 4 * len(w) + 2 * len(known[w][1])

    def run(texts: list[str | None]) -> list[list]:
        counts, ids, decoded = [], [], []
        split_texts = [stretches(t or "") for t in texts]
        learn(set().union(*split_texts))
        for parts in split_texts:
            found = [known[w] for w in parts]
            a, b = b" ".join([f[1] for f in found if f[0]]), b" ".join([f[2] for f in found if f[0]])
            counts.append(sum([f[0] for f in found]))
            ids.append(hashlib.sha256(a).hexdigest() if digest else [int(x) for x in a.split()])
            decoded.append(hashlib.sha256(b).hexdigest() if digest else b.decode())
        return [counts, ids, decoded] if digest else [ids, decoded]

    return run


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): the token ids of each text and the text that they decode to."""
    tokenizer = Tokenizer(path)
    return common.per_text(df, lambda: encoder(tokenizer), FIELDS, id_col, text_col)


def encode_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): as encode, but only digests leave the task."""
    tokenizer = Tokenizer(path)
    return common.per_text(df, lambda: encoder(tokenizer, True), DIGESTS, id_col, text_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): token names joined by spaces, special tokens included; null ids decode to an empty text."""
    names = Tokenizer(path).names

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [" ".join(names[k] for k in ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "decoded"])

    return df.select(id_col, ids_col).mapInArrow(run, T.StructType([df.schema[id_col], T.StructField("decoded", T.StringType())]))

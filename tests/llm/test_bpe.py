import hashlib
import random

import public_tokenizers
import pytest
from dossierflow.llm import bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def texts():
    r = random.Random(9)
    bits = ["a", "the", "in", "'s", "'", "É", "ñ", " ", "\n", "1", "!!", "aaa", "hello", "<|endoftext|>", "<|STARTOFTEXT|>", "ing", "ß", "Σ", "ς", "中", " ́", " ", "\x1c", "\x00", "日本", "٣", "😀", "İ"]
    out = ["", " ", "a" * 5000, "ab" * 3000, "<|startoftext|>" * 3, *("".join(r.choice(bits) for _ in range(r.randrange(50))) for _ in range(3000))]
    return out + [f"x{chr(c)}y {chr(c)}{chr(c)} 1{chr(c)}" for c in [*range(0xD800), *range(0xE000, 0xFFFF, 5)] if c % 3 == 0 or 0x1C80 < c < 0x1C90 or 0xA7C0 < c < 0xA7F0]


def test_ids_and_decoded_texts_match_the_library(library):
    every = texts()
    ids, decoded = bpe.encoder(bpe.Tokenizer(PATH))(every)
    for text, got, back, want in zip(every, ids, decoded, library.encode_batch(every, add_special_tokens=False), strict=True):
        assert got == want.ids, text
        assert back == library.decode(want.ids, skip_special_tokens=False)


def test_kept_words_are_bounded_and_digests_agree(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 50)
    every = [t for t in texts()[:400]]
    tokenizer = bpe.Tokenizer(PATH)
    ids, decoded = bpe.encoder(tokenizer)(every)
    counts, a, b = bpe.encoder(tokenizer, True)(every)
    assert counts == [len(i) for i in ids]
    assert a == [hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest() for i in ids] and b == [hashlib.sha256(d.encode()).hexdigest() for d in decoded]


def test_frames(spark):
    df = spark.createDataFrame([(1, "Hello world", 1), (2, None, 2), (None, "", 3), (1, "Hello world", 1)], "doc_id long, text string, ids int")
    out = bpe.encode(df, PATH)
    rows = out.collect()
    assert rows[0]["ids"] == rows[3]["ids"] and rows[1]["ids"] == [] and rows[1]["decoded"] == ""
    assert [r["decoded"] for r in bpe.decode(out.drop("decoded"), PATH).collect()] == [r["decoded"] for r in rows]
    assert bpe.encode_digests(df.limit(0), PATH).count() == 0


def test_long_words_match_the_library_and_cost_in_proportion(library):
    import time

    r, run = random.Random(12), bpe.encoder(bpe.Tokenizer(PATH))
    for letters in ("etaoinshrdlu", "ab", "a", "漢字日本語", "QWxhZGRpbjpv0123+/"):
        for n in (bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 20_000):
            word = "".join(r.choice(letters) for _ in range(n))
            assert run([word])[0][0] == library.encode(word, add_special_tokens=False).ids
    start = time.process_time()
    run(["".join(r.choice("etaoinshrdlu") for _ in range(400_000))])
    assert time.process_time() - start < 20

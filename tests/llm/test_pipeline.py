"""The pipeline against plain versions of its stages on one small table."""

import random

import corpus_pipeline
from dossierflow.llm import pii
from tests.llm.test_lines import expected
from tests.llm.test_packing import plain
from tests.llm.test_repetition import brute
from tests.llm.test_simhash import plain_fingerprint, reach


def test_stages_match_plain_versions(spark, tmp_path):
    r = random.Random(15)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    texts = ["\n".join(" ".join(word() for _ in range(r.randint(20, 40))) for _ in range(4)) for _ in range(25)]
    texts += [texts[0], texts[1].replace(" ", " x ", 1), texts[2] + "\n" + texts[3].split("\n")[0], texts[4] + "\nmail a.b@c.de or +1 (212) 555-0000", "junk " * 80, "", None, texts[5][:-1] + "Z"]
    docs = [(k, t, "en", r.choice(["hot", "hot", "b", None]), len(t) if t else None, "extra") for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, bin_id string").write.parquet(str(tmp_path / "documents.parquet"))

    kept = {k: t for k, t, *_ in docs if brute(t)[-1]}
    cleaned = {k: t for k, t in expected(list(kept.items())).items() if t.strip() or not kept[k].strip()}
    prints = {k: plain_fingerprint(t) for k, t in cleaned.items()}
    single = {k: cleaned[k] for k, low in reach(sorted(prints.items())).items() if k == low}
    run = pii.finder(pii.trained())
    masked = {}
    for k, t in single.items():
        out, done = "", 0
        for kind, a, b in sorted(run([t])[0][1], key=lambda s: s[1]):
            out, done = out + t[done:a] + f"<{kind.upper()}>", b
        masked[k] = out + t[done:]

    frame, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        seen.append(frame.collect())
        frame = spark.createDataFrame(seen[-1], frame.schema)
    for rows, want in zip(seen, (kept, cleaned, single, masked), strict=False):
        assert {x["doc_id"]: x["text"] for x in rows} == want
        assert rows[0].__fields__ == corpus_pipeline.COLUMNS
    order = sorted(masked, key=lambda k: (-len(masked[k].split()), k))
    source = {k: s for k, _, _, s, *_ in docs}
    want = dict(zip(order, plain([len(masked[k].split()) for k in order], [source[k] for k in order], [None] * len(order), 2048), strict=True))
    assert {x["doc_id"]: (x["bin_id"], x["offset"]) for x in seen[-1]} == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, seen[-1]))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

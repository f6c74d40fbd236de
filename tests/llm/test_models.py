"""Quality classifier and language ID: held-out accuracy, plain versions, defined results for odd rows."""

import math
import random

import numpy as np

from dossierflow.llm import common, langid, quality
from pyspark.sql import functions as F

WORDS = {"aa": ["lor", "em", "ip", "sum", "dol", "or"], "bb": ["zer", "schn", "ung", "heit", "ver", "ich"], "cc": ["ção", "não", "eira", "ões", "lha", "ém"]}


def sentence(r, lang, n):
    return " ".join("".join(r.choice(WORDS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_language_of_held_out_texts(spark):
    r = random.Random(13)
    rows = [(k, sentence(r, lang, r.randint(3, 60)), lang, "s") for k in range(400) for lang in [r.choice(list(WORDS))]]
    rows += [(1000, None, "aa", "s"), (1001, "12 34 !", "bb", "s"), (1002, "", None, "s"), (None, "lorem ipsum", "aa", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").withColumns({"id": F.lit(1), "o": F.lit(2)})
    got = {x["doc_id"]: x for x in langid.language_id(df).collect()}
    held = [(k, lang) for k, t, lang, _ in rows[:400] if common.held_out(k)]
    assert sum(got[k]["lang_pred"] == lang for k, lang in held) / len(held) > 0.98
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (1000, 1001, 1002))
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert {x["lang_pred"] for x in langid.language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.language_id(df.limit(0)).count() == 0


def test_quality_of_held_out_texts(spark):
    r = random.Random(14)
    good = lambda: ". ".join(sentence(r, "aa", r.randint(4, 12)).capitalize() for _ in range(r.randint(3, 9))) + "."
    junk = lambda: r.choice([" ".join(["spam"] * r.randint(20, 90)), "$$$ ".join(sentence(r, "aa", 30).split()), sentence(r, "aa", 40).upper().replace(" ", "!! ")])
    rows = [(k, good() if k % 5 else junk()) for k in range(600)]
    df = spark.createDataFrame([*rows, (9000, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 > 0)) for k, _ in rows if k % 4] + [(9000, None)], "doc_id long, quality int")
    got = {x["doc_id"]: x for x in quality.quality_scores(df, labels).collect()}
    held = [k for k, _ in rows if common.held_out(k)]
    assert sum(got[k]["predicted"] == (k % 5 > 0) for k in held) / len(held) > 0.97
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got.values())
    assert {x["score"] for x in quality.quality_scores(df, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(df.limit(0), labels).count() == 0


def test_discriminant_against_plain_densities():
    g = np.random.default_rng(3)
    x = np.concatenate([g.normal(0, 1, (90, quality.N_FEATURES)), g.normal(1, 2, (60, quality.N_FEATURES))])
    y = np.repeat([0, 1], [90, 60])
    model = quality.fit(x, y)
    z = [[(v - m) / s for v, m, s in zip(row, x.mean(axis=0), x.std(axis=0) + quality.FLOOR, strict=True)] for row in x]
    own, mean = {}, {}
    for k in (0, 1):
        rows = [r for r, c in zip(z, y, strict=True) if c == k]
        mean[k] = [sum(c) / len(rows) for c in zip(*rows, strict=True)]
        d = range(len(mean[k]))
        own[k] = [[sum((r[i] - mean[k][i]) * (r[j] - mean[k][j]) for r in rows) / (len(rows) - 1) for j in d] for i in d]
    want = []
    for row in z[::7]:
        log = {}
        for k in (0, 1):
            pooled = [[0.6 * a + 0.4 * b for a, b in zip(p, q, strict=True)] for p, q in zip(own[0], own[1], strict=True)]
            mixed = [[0.9 * own[k][i][j] + 0.1 * pooled[i][j] for j in range(len(row))] for i in range(len(row))]
            shrunk = np.array([[mixed[i][j] * (1 if i == j else 0.9) + (quality.FLOOR if i == j else 0) for j in range(len(row))] for i in range(len(row))])
            away = np.array(row) - np.array(mean[k])
            log[k] = math.log([0.6, 0.4][k]) - 0.5 * np.linalg.slogdet(shrunk)[1] - 0.5 * away @ np.linalg.solve(shrunk, away)
        want.append(1 / (1 + math.exp(-model.temper * (log[1] - log[0]))))
    assert model.temper in quality.TEMPERS and np.allclose(model.score(x[::7]), want, atol=1e-9)


def test_kernel_regression_against_a_plain_version():
    r = random.Random(21)
    made = [(sentence(r, lang, r.randint(2, 12)), lang) for lang in WORDS for _ in range(20)]
    r.shuffle(made)

    def plain_set(text):
        spaced = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        return {spaced[i : i + n] for n in (1, 2, 3) for i in range(len(spaced) - n + 1) if spaced[i : i + n].strip() and not (n == 1 and spaced[i] == " ")}

    sets = [plain_set(t) for t, _ in made]
    for (t, _), s in zip(made, sets, strict=True):
        assert len(np.unique(langid.grams(t))) == len(s)  # no two n-grams of these texts share a number
    model = langid.Model([np.unique(langid.grams(t)) for t, _ in made], [lang for _, lang in made])
    marks, each = [], {k: 0 for k in WORDS}
    for i, (_, lang) in enumerate(made):
        if each[lang] < langid.LANDMARKS // 3:
            each[lang] += 1
            marks.append(i)
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    between = np.array([[kernel(sets[i], sets[j]) for j in marks] for i in marks])
    value, vector = np.linalg.eigh(between)
    features = np.array([[kernel(s, sets[j]) for j in marks] for s in sets]) @ (vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T)
    features = np.column_stack([features, np.ones(len(sets))])
    margins = []
    for lang in sorted(WORDS):
        want = np.array([1.0 if own == lang else -1.0 for _, own in made])
        margins.append(features @ np.linalg.solve(features.T @ features + langid.RIDGE * np.eye(features.shape[1]), features.T @ want))
    margins = np.array(margins).T
    names, scores = model.predictor()([t for t, _ in made])
    assert names == [sorted(WORDS)[k] for k in margins.argmax(axis=1)]
    assert np.allclose(scores, np.clip((margins.max(axis=1) + 1) / 2, 0, 1), atol=1e-3)


def test_samples_stay_bounded_where_rows_repeat(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 20)
    monkeypatch.setattr(quality, "SAMPLE", 50)
    r, free = random.Random(9), next(k for k in range(9) if not common.held_out(k))
    rows = [(k % 4, sentence(r, "aa", 5), "aa") for k in range(3000)] + [(free, "same text here", "bb")] * 5000 + [(k, sentence(r, "cc", 5), "cc") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sets, langs = langid.sample(df, "doc_id", "text", "lang")
    assert {k: langs.count(k) for k in set(langs)} == {"aa": 20, "bb": 1, "cc": 20} and len(sets) == 41
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(0, 1), (2, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((x, y)))
    quality.train(df, labels, "doc_id", "text")
    assert len(seen[0][0]) == len(seen[0][1]) == 50


def test_scripts_do_not_collapse_and_long_texts_are_read_whole(spark):
    r = random.Random(4)
    scripts = {"el": "αβγδεζηθικλμν", "ru": "абвгдежзиклмн", "he": "אבגדהוזחטיכלמ", "hi": "कखगघचछजझटठडढण", "ta": "கஙசஞடணதநபமயரல", "ja": "あいうえおかきくけこさしす", "ko": "가나다라마바사아자차카타파", "th": "กขคงจฉชซญฐณดต"}
    text = lambda lang, n: " ".join("".join(r.choice(scripts[lang]) for _ in range(r.randint(2, 6))) for _ in range(n))
    rows = [(k, text(lang, 8), lang, "x", 0.5) for k in range(600) for lang in [r.choice(list(scripts))]]
    rows += [(5000, "12 ! " * 200_000 + text("ko", 3), None, "x", None), (5001, text("ru", 60_000), None, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    got = {x["doc_id"]: x["lang_pred"] for x in langid.language_id(df).collect()}
    assert got[5000] == "ko" and got[5001] == "ru"
    assert all(got[k] == lang for k, _, lang, *_ in rows[:600])
    marks = spark.createDataFrame([(k, k % 2, 1) for k in range(600)], "doc_id long, quality int, score int")
    assert all(0 <= x["score"] <= 1 for x in quality.quality_scores(df, marks).collect())

import random
import re

from dossierflow.llm import licences


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in licences.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_columns_match_brute_force():
    r = random.Random(11)
    bits = ["cc", "by", "CC-BY", "general", "public", "license", "all", "rights", "reserved", "é", "cc by cc by", ",", "\n", "x1", "All rights reserved."]
    every = [None, "", *(" ".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(500))]
    got = licences.scanner()(every)
    assert list(zip(*got[:5], strict=True)) == [base(t) for t in every]
    assert all(set(b.split(",")) - {""} <= set(l.split(",")) and 0 <= s <= 1 for b, l, s in zip(got[4], got[5], got[6], strict=True))


def test_matching_statistics_match_brute_force():
    templates = {"a": ["x y z x y w", "y z q"], "b": ["w x y z"]}
    automaton = licences.Automaton(templates)
    every = [t.split() for ts in templates.values() for t in ts]
    r = random.Random(12)
    for _ in range(400):
        words = [r.choice("xyzwq") for _ in range(r.randrange(25))]
        ends = {}
        for e in range(1, len(words) + 1):
            ends[e] = max((n for n in range(1, e + 1) if any(words[e - n : e] == t[i : i + n] for t in every for i in range(len(t)))), default=0)
        want = [(e - n, n) for e, n in ends.items() if n >= licences.LEAST and ends.get(e + 1, 0) != n + 1]
        got = [(s, n) for s, n, _ in automaton.matches([automaton.number[w.encode()] for w in words], 0)]
        assert got == want


def test_templates_are_found_whole_and_in_parts():
    mit = licences.TEMPLATES["mit"][2]
    words = mit.split()
    broken = " ".join([*words[:20], "oddly", *words[20:40], "and", "so", *words[40:]])
    got = licences.scanner()([f"intro {mit} end", broken, " ".join(words[:8]), "the software is used in many places by all of us"])
    assert got[5] == ["mit", "mit", "", ""] and got[6][0] == 1.0 and 0.75 <= got[6][1] <= 1 and got[7][0] == f"mit:1:{len(words) + 1}"


def test_frame(spark):
    df = spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0.", "l"), (2, None, None), (None, "", "l")], "doc_id long, text string, labels string")
    assert [r["labels"] for r in licences.licence_scan(df).collect()] == ["cc-by,cc-by-nc", "", ""]
    assert licences.licence_scan(df.limit(0)).count() == 0


def covered(words, template):
    """Largest number of template words in a chain of runs, over all chains of runs of LEAST words and more."""
    runs = [(i, j, n) for i in range(len(words)) for j in range(len(template)) for n in range(licences.LEAST, len(template) + 1) if words[i : i + n] == template[j : j + n] and len(words) >= i + n and len(template) >= j + n]
    best = {}
    for i, j, n in sorted(runs):
        best[i, j, n] = n + max((best[r] for r in best if r[0] + r[2] <= i and r[1] + r[2] <= j and i - r[0] - r[2] <= licences.GAP), default=0)
    return max(best.values(), default=0)


def test_chains_against_all_chains_of_runs():
    r = random.Random(31)
    exact = 0
    for _ in range(150):
        template = [r.choice("abcdefgh") + r.choice("xy") for _ in range(14)]
        automaton = licences.Automaton({"t": [" ".join(template)]})
        words = list(template)
        for _ in range(r.randrange(4)):
            k = r.randrange(len(words))
            words[k : k + r.randrange(2)] = [r.choice(template)] * r.randrange(1, 2)
        ids = [automaton.number[w.encode()] for w in words]
        got = max((c[0] * len(template) for c in automaton.chains(automaton.matches(ids, 0))), default=0)
        want = covered(words, template)
        # only runs that nothing prolongs are chained, each under its own end: no more than all chains give, and rarely less
        assert got <= want + 1e-9
        exact += abs(got - want) < 1e-9
    assert exact >= 135


def test_recall_on_changed_templates_and_clean_texts():
    r, scan, hit, total = random.Random(41), licences.scanner(), 0, 0
    for label, texts in licences.TEMPLATES.items():
        for text in texts:
            for _ in range(4):
                words = text.split()
                for _ in range(len(words) // 25):
                    k = r.randrange(len(words))
                    words[k : k + 1] = r.choice([[], ["some"], [words[k], "foo", "bar"]])
                text_with = " ".join(["lorem"] * r.randrange(30) + words + ["ipsum"] * 9)
                total += 1
                hit += label in scan([text_with])[5][0].split(",")
    assert hit >= 0.95 * total
    # 60,000 words drawn from the templates themselves: only a short notice can come about by chance
    words = [w for texts in licences.TEMPLATES.values() for t in texts for w in t.split()]
    spans = scan([" ".join(r.choice(words) for _ in range(3000)) for _ in range(20)])[7]
    assert sum(map(bool, spans)) <= 1
    plain = "the software and the work that this person made is free for any use by others in the past without fee or warranty of the kind"
    assert scan([" ".join(r.choice(plain.split()) for _ in range(3000)) for _ in range(20)])[7] == [""] * 20


def test_very_long_text():
    scan, notice = licences.scanner(), "Licensed under the Apache License, Version 2.0"
    text = "the software of the license and the copyright notice in all copies " * 40_000
    got = scan([text, text + notice])
    assert got[5] == ["", "apache"] and got[0][0] == 12 * 40_000

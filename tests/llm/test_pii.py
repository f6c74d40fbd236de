import random
import re

from dossierflow.llm import pii


def plain(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_match_the_patterns():
    r = random.Random(6)
    bits = ["a", "@", ".", "-", "1", "23", "255", "256", " ", "+4", "(", ")", "4111 1111 1111 1111", "é", "b.c", "x@y.z", "%", "\n", "0000"]
    for _ in range(4000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(40)))
        assert pii.base_spans(text) == plain(text), text
    assert pii.base_spans("0" * 6000 + "1.2.3.4") == [("ip", 0, 6007)]


def test_model_adds_obfuscated_data_and_leaves_clean_text_alone():
    run = pii.finder(pii.trained())
    texts = ["ring (555) 123-4567 soon", "host 10[.]0[.]3[.]44 fell", "card 4111.1111.1111.1111 now", 'token = "9ce9999c999999999" and CC BY-NC 4.0. On 2024-01-12, $3,400.00.', "plain words " * 300, None, ""]
    found = [[(k, (t or "")[a:b]) for k, a, b in every] for t, (_, every) in zip(texts, run(texts), strict=True)]
    assert found == [[("phone", "(555) 123-4567")], [("ip", "10[.]0[.]3[.]44")], [("card", "4111.1111.1111.1111")], [], [], [], []]


def test_base_spans_stay_and_windows_agree_with_their_place():
    run = pii.finder(pii.trained())
    text = "a.b@c.de, +1 (212) 555-0000 and 192.168.1.1 or 555-123-4567 end"
    alone = {(k, text[a:b]) for k, a, b in run([text])[0][1]}
    for shift in (1, 37, 90, 500):
        moved = " ".join(["word"] * shift) + " " + text
        base, every = run([moved])[0]
        assert set(base) <= set(every) and base == pii.base_spans(moved)
        assert {(k, moved[a:b]) for k, a, b in every} == alone


def test_reconciling_picks_the_heaviest_set():
    text = "call 555-123-4567 x"
    spans = [("phone", 5, 17), ("phone", 5, 17), ("phone", 9, 17)]
    assert pii.reconciled(text, spans, []) == [("phone", 5, 17)]
    assert pii.reconciled(text, spans, [("ip", 4, 6)]) == []


def test_frames(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.de", "s"), (2, None, None), (None, "", "s"), (1, "mail a.b@c.de", "s")], "doc_id long, text string, spans string")
    got = pii.find(df).collect()
    assert [r["spans"] for r in got] == ["email:5:13", "", "", "email:5:13"]
    assert [r["text"] for r in pii.mask(df).collect()] == ["mail <EMAIL>", None, "", "mail <EMAIL>"]
    assert pii.find(df.limit(0)).count() == 0


def tagged(tags):
    """(kind, start, end) of each tagged span."""
    edges = [i for i, t in enumerate(tags) if t % 2] + [len(tags)]
    return [(pii.KINDS[tags[a] // 2], a, next((i for i in range(a + 1, b) if tags[i] != tags[a] + 1), b)) for a, b in zip(edges, edges[1:], strict=False)]


def test_recall_and_precision_on_sentences_that_were_not_learned_from():
    run, r = pii.finder(pii.trained()), random.Random(2024)
    wanted, hit, false = ({k: 0 for k in pii.KINDS} for _ in range(3))
    for n in range(400):
        text, tags = pii.example(r, pii.WINDOW if n % 8 else 4 * pii.WINDOW)
        want = [s for s in tagged(tags.tolist()) if s[2] < len(text)]
        base, every = run([text])[0]
        for s in want:
            if not any(b[1] < s[2] and s[1] < b[2] for b in base):
                wanted[s[0]] += 1
                hit[s[0]] += s in every
        for s in set(every) - set(base):
            false[s[0]] += s[2] < len(text) and s not in want
    for k in pii.KINDS:
        assert wanted[k] > 50 and hit[k] >= 0.9 * wanted[k] and false[k] <= 0.1 * wanted[k], (k, hit, wanted, false)


def test_spans_of_any_length_and_very_long_texts():
    run, r = pii.finder(pii.trained()), random.Random(5)
    for n in (5, 40, 63, 64, 65, 100, 300, 1000):
        name = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        text = f"write to {name} [at] host [dot] com now"
        assert run([text])[0][1] == [("email", 9, 9 + n + 20)], n
    filler = "plain words without numbers " * 40_000
    text = filler + "ring (555) 123-4567 soon " + filler
    assert run([text, "x" * 200_000])[0][1] == [("phone", len(filler) + 5, len(filler) + 19)]


def test_training_learns_the_generators_spans(monkeypatch):
    monkeypatch.setattr(pii, "EXAMPLES", ((pii.WINDOW, 480),))
    monkeypatch.setattr(pii, "EPOCHS", 5)
    model = pii.fitted()
    assert {k: v.shape for k, v in model.items()} == {k: v.shape for k, v in pii.trained().items()}
    made = [pii.example(random.Random(k)) for k in range(40)]
    tags = pii.decode(model, pii.np.stack([pii.classes(t) for t, _ in made]).T).T
    right = sum((a == b).sum() for a, (_, b) in zip(tags, made, strict=True))
    assert right > 0.75 * 40 * pii.WINDOW

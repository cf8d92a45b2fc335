"""Personal data: the rules against plain patterns, gradients against differences, windows against decoding everything, planted forms."""

import hashlib
import random
import re

import numpy as np
import pytest

from cuelake.llm import bilstm, pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip":
                good = all(int(p) <= 255 for p in m[0].split("."))
            elif kind == "card":
                good = 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
            else:
                good = kind == "email" or 10 <= len(digits) <= 15
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def tagger():
    words = "Eauouon enpaeux leaux le ouè and the of over meeting Über größe contact number is from".split()
    rng = random.Random(1)
    sample = [(w, pii.base_spans(w)) for w in (" ".join(rng.choice(words) for _ in range(20))[: pii.WINDOW] for _ in range(60))]
    ids, tags = pii.labelled(sample)
    return bilstm.Tagger(bilstm.fit(ids, tags, pii.CHARS, pii.HIDDEN, pii.forbidden(), pii.STEPS, pii.BATCH, pii.RATE, pii.SEED), pii.forbidden())


def test_rules_equal_plain_patterns():
    rng, gen = random.Random(2), np.random.default_rng(2)
    for _ in range(4000):
        text = "".join(rng.choice("0123456789 .-@+()ab%_é\n,") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == plain(text), text
    for _ in range(800):
        text = "".join(rng.choice([pii.planted(rng.randrange(4), gen), pii.decoy(gen), "word", "@", "+", "é"]) + rng.choice([" ", "", ". ", "-"]) for _ in range(rng.randrange(9)))
        assert pii.base_spans(text) == plain(text), text


@pytest.mark.parametrize("piece", ["a", "1", "1.", "1 ", "+1", "+1((", "a@", "@", "a@b.", "a.b@", "1.1.1.1 "])
def test_rules_take_linear_time(piece):
    import time

    seconds = []
    for n in (100_000, 400_000):
        began = time.process_time()
        pii.base_spans(piece * n)
        seconds.append(time.process_time() - began)
    assert seconds[1] < 12 * max(seconds[0], 0.02)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    forbidden = pii.forbidden()[:5, :5]
    p = bilstm.initial(7, 3, 5, 1)
    ids, tags = rng.integers(0, 7, (3, 6)), np.array([[0, 1, 2, 2, 0, 3], [3, 4, 4, 0, 1, 1], [0] * 6])
    _, grads = bilstm.loss_and_gradients(ids, tags, p, forbidden)
    for k in bilstm.KEYS:
        for at in [tuple(rng.integers(0, s) for s in p[k].shape) for _ in range(6)]:
            if k == "A" and forbidden[at] < 0:
                continue
            moved = [{**p, k: p[k].copy()} for _ in range(2)]
            moved[0][k][at] += 1e-5
            moved[1][k][at] -= 1e-5
            up, down = (bilstm.loss_and_gradients(ids, tags, m, forbidden)[0] for m in moved)
            assert abs((up - down) / 2e-5 - grads[k][at]) < 1e-5


def test_decoding_equals_all_paths():
    import itertools

    rng = np.random.default_rng(4)
    forbidden = pii.forbidden()[:3, :3]
    for seed in range(12):
        p = {k: v * 2 for k, v in bilstm.initial(5, 3, 3, seed).items()}
        p["A"], p["s"], p["e"] = rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3), rng.normal(0, 1, 3)
        p["bo"][0] += rng.choice([0, 8])
        t, ids = bilstm.Tagger(p, forbidden), rng.integers(0, 5, (4, 6))
        em, got = t.emissions(ids), t.decode(ids)
        score = lambda s, y: t.s[y[0]] + t.e[y[-1]] + sum(em[i, s, v] for i, v in enumerate(y)) + sum(t.a[a, b] for a, b in zip(y, y[1:]))
        for s in range(4):
            assert score(s, got[s]) >= max(score(s, y) for y in itertools.product(range(3), repeat=6)) - 1e-4


def test_planted_forms_are_learned(tagger):
    ids, tags = pii.labelled([("Ein anderer Satz steht hier und der nächste folgt ihm bald nach", [])], seed=77, extra=600)
    found = {(r, *s) for r, row in enumerate(tagger.decode(ids)) for s in pii.tagged_spans(row)}
    true = {(r, *s) for r, row in enumerate(tags) for s in pii.tagged_spans(row)}
    assert len(found & true) > 0.85 * len(true) and len(found & true) > 0.85 * len(found)


def test_skipped_windows_could_add_nothing(tagger):
    rng, gen = random.Random(5), np.random.default_rng(5)
    texts = ["", " ", "plain words only " * 40]
    for _ in range(60):
        parts = [rng.choice(["word ", "größer ", "\n", pii.planted(rng.randrange(4), gen) + " ", pii.decoy(gen) + " ", "x" * rng.randrange(300) + " "]) for _ in range(rng.randrange(60))]
        texts.append("".join(parts))
    texts.append("a" * 500 + "@" + "b" * 500 + ".com " + "1 " * 300)
    assert pii.all_spans(tagger, texts) == pii.all_spans(tagger, texts, every=True)
    tags = pii.tag_texts(tagger, texts)
    for text, (base, added), own in zip(texts, pii.all_spans(tagger, texts), tags, strict=True):
        assert base == plain(text) and len(own) == len(text)
        for s, k, e in added:
            assert 0 <= s < e <= len(text) and not any(a < e and s < b for a, _, b in base)
            assert pii.confirmed(text, s, k, e) == (s, k, e)


def test_spans_of_tags():
    tags = np.array([0, 1, 2, 2, 1, 3, 4, 0, 2, 2, 5], np.uint8)
    assert pii.tagged_spans(tags) == [(1, 0, 4), (4, 0, 5), (5, 1, 7), (8, 0, 10), (10, 2, 11)]
    assert pii.tagged_spans(np.zeros(0, np.uint8)) == []


def test_adds_what_the_rules_miss_and_leaves_clean_texts_alone(tagger):
    text = "call (743) 555-3824 now, or 4465758382889437 4465758382889437 and jane.doe (at) mail (dot) example, see 2024-05-06 and 1.2.3"
    (base, added), = pii.all_spans(tagger, [text])
    assert base == []
    assert {text[s:e] for s, _, e in added} >= {"(743) 555-3824", "4465758382889437"}
    clean = "The version 1.2.3 of 12 May 2021 had 10,000 lines, 3 parts and 4111 1111 1111 1112 is no card"
    assert pii.all_spans(tagger, [clean])[0] == ([], [])


def test_operator(spark, tagger):
    texts = ["mail a.b@c.de, ip 10.0.0.1.", None, "", "+1 (743) 555-3824 " * 3, "é" * 200_000 + " 4111111111111111"]
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(0, texts[0], "y", 9), (None, texts[0], "z", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string, kind int")
    out = pii.digests(pii.find(df, tagger)).collect()
    assert len(out) == len(rows)
    for r in out:
        text = texts[r.doc_id or 0] or ""
        base = plain(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.digest(base).encode()).hexdigest()
        assert set(filter(None, pii.digest(base).split(","))) <= set(r.spans.split(","))
    cut = {r.kind: r.text for r in pii.redact(df, tagger).collect()}
    assert cut[1] is None and cut[2] == "" and cut[9] == "mail [EMAIL], ip [IP]." and cut[3].count("[PHONE]") == 3
    model = pii.train(df, steps=3)
    assert pii.find(spark.createDataFrame([], df.schema), model).count() == 0
    assert pii.find(df.select("doc_id", "text"), model).count() == len(rows)

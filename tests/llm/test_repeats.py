"""Suffix-array dedup and sentence-span dedup against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from cuelake.llm import repeats, spans, suffix


def test_suffix_array_against_sorting():
    r = np.random.default_rng(1)
    for _ in range(150):
        t = np.append(r.integers(1, r.integers(2, 6), r.integers(0, 60)), 0).astype(np.uint16)
        own = t.tolist()
        sa = suffix.suffix_array(t)
        assert sa.tolist() == sorted(range(len(own)), key=lambda i: own[i:])  # noqa: B023
        prefixes = suffix.permuted_prefixes(t, sa, 100)
        for a, b in zip(sa, sa[1:], strict=False):
            n = 0
            while max(a, b) + n < len(own) and own[a + n] == own[b + n]:
                n += 1
            assert prefixes[b] == n


def brute_removed(rows, length=100):
    """Covered bytes of each (id, text), by remembering every window under smaller ids and in the text itself."""
    smaller, out = set(), {}
    texts = {}
    for d, t in rows:
        if d is not None:
            texts.setdefault(d, set()).add((t or "").encode())
    for doc_id in sorted(texts):
        fresh = set()
        for text in texts[doc_id]:
            gone, own = np.zeros(len(text), bool), set()
            for k in range(len(text) - length + 1):
                w = text[k : k + length]
                if w in smaller or w in own:
                    gone[k : k + length] = True
                own.add(w)
            fresh |= own
            out[doc_id, text] = gone
        smaller |= fresh
    return out


def expected(rows, want):
    """(doc_id, bytes, spans, kept) of every row."""
    out = Counter()
    for d, t in rows:
        text = (t or "").encode()
        gone = want[d, text] if d is not None else np.zeros(len(text), bool)
        turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out[d, len(text), tuple(map(int, turns)), np.frombuffer(text, np.uint8)[~gone].tobytes()] += 1
    return out


def found(rows):
    return Counter((x.doc_id, x.n_bytes, tuple(v for s in x.spans for v in (s.first, s.last)), bytes(x.kept)) for x in rows)


def make_texts(r):
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(40) for _ in range(4)] + ["ab" * 150, "x" * 400]
    out = []
    for _ in range(60):
        parts = [text(r.randrange(5, 60)) for _ in range(3)]
        for _ in range(r.randrange(3)):
            p = r.choice(passages)
            k = r.randrange(0, 40)
            parts.insert(r.randrange(4), p[k : len(p) - r.randrange(0, 40)])
        out.append(r.choice(["", " "]).join(parts))
    return out + out[:5] + [None, "", "short", "z" * 5000, "é" * 120, "z" * 99]


def check_repeats(spark, rows):
    frame = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, kept string").repartition(5)
    assert found(repeats.remove_repeats(frame).collect()) == expected(rows, brute_removed(rows))


def test_repeats_against_windows(spark):
    texts = make_texts(random.Random(7))
    rows = [(3 * i - 20, t) for i, t in enumerate(texts)]
    rows += [rows[2], rows[50], (None, texts[1]), (None, None)]
    check_repeats(spark, rows)
    check_repeats(spark, rows + [(rows[9][0], texts[3]), (rows[9][0], texts[9] + texts[3]), (rows[9][0], texts[12]), (rows[30][0], None), (rows[30][0], texts[31])])
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_crowded_anchors_long_texts_and_clashing_columns(spark, monkeypatch):
    """Anchors with more segments than one task may hold, and a text of several blocks."""
    monkeypatch.setattr(repeats, "HOT_SEGMENTS", 8)
    r = random.Random(17)
    noise = lambda n: "".join(r.choice("abcdefghé ") for _ in range(n))
    common, longer = noise(60), noise(130)
    texts = [noise(r.randrange(200)) + r.choice([common, longer, longer[10:]]) + noise(r.randrange(200)) for _ in range(120)]
    texts += [noise(620_000) + texts[3] + noise(300) + texts[4] + longer, "q" * 3000, texts[7], None]
    rows = [(2 * i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, spans int, anchor int").repartition(6)
    assert found(repeats.remove_repeats(frame).collect()) == expected(rows, brute_removed(rows))
    same = [(5, t) for _, t in rows] + [(1, longer), (9, texts[4])]
    frame = spark.createDataFrame([(d, t, 1) for d, t in same], "doc_id long, text string, variant int").repartition(6)
    assert found(repeats.remove_repeats(frame).collect()) == expected(same, brute_removed(same))


def test_an_unrelated_text_of_the_same_id_stays(spark):
    r = random.Random(2)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    x, b = noise(300), noise(400)
    rows = [(1, x), (2, x + noise(50)), (2, b), (2, b)]
    got = {(y.n_bytes, len(y.kept)) for y in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(300, 300), (350, 50), (400, 400)}
    words = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) + r.choice(["", "", "."]) for _ in range(60))
    x, b = words(), words()
    rows = [(1, x), (2, x + " tail."), (2, b), (2, b)]
    df = spark.createDataFrame([(d, t, 1, 2, "v", 3) for d, t in rows], "doc_id long, text string, __id int, __spans int, variant string, row int")
    got = spans.drop_repeated_spans(df).collect()
    assert sum(y.text == b for y in got) == 2 and all((y["__id"], y["__spans"], y.variant, y.row) == (1, 2, "v", 3) for y in got)


def test_windows_of_one_shard():
    """Whole texts as the regions of one shard."""
    texts = make_texts(random.Random(8))
    want = {d: (t, gone) for (d, t), gone in brute_removed(list(enumerate(texts))).items()}
    docs, starts, regions = [], [], []
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        if len(raw) >= 100:
            docs.append(i), starts.append(0), regions.append(raw)
    own, at = repeats.earlier_windows(regions, np.array(docs), np.array(starts))
    marked = {}
    for k, p in zip(own, at, strict=True):
        marked.setdefault(docs[k], np.zeros(len(regions[k]), bool))[p : p + 100] = True
    for i, (text, gone) in want.items():
        assert (marked.get(i, np.zeros(len(text), bool)) == gone).all()


STOPS, CLOSERS = ".!?…؟۔।॥։።፧。！？｡", "\"')]}’”»›」』】）"


def plain_words(text):
    """(word, line) of a text; a wide stop and what closes behind it end a word."""
    out = []
    for number, line in enumerate(text.split("\n")):
        for w in re.split(r"[\t-\r ]+", line):
            out += [(x, number) for x in re.findall(r"[^。！？｡]*[。！？｡]+[\"')\]}’”»›」』】）]*|[^。！？｡]+", w)]
    return out


def plain_units(words):
    """Lists of word numbers: sentences, and phrases of long ones."""
    sentences, unit = [], []
    for k, (w, line) in enumerate(words):
        unit.append(k)
        bare = w.rstrip(CLOSERS)
        if (bare and bare[-1] in STOPS) or k + 1 == len(words) or words[k + 1][1] != line:
            sentences.append(unit)
            unit = []
    out = []
    for unit in sentences:
        h = [zlib.crc32(words[k][0].lower().encode()) * 0x9E3779B1 % 2**32 for k in unit]
        begin = 0
        for i in range(3, len(unit) - 3):
            if h[i] < min(h[i - 3 : i]) and h[i] <= min(h[i + 1 : i + 4]):
                out.append(unit[begin:i])
                begin = i
        out.append(unit[begin:])
    return out


def brute_spans(rows, run=4):
    """Words that each (id, text) keeps."""
    smaller, out, texts = set(), {}, {}
    for d, t in rows:
        if d is not None and t is not None:
            texts.setdefault(d, set()).add(t)
    for doc_id in sorted(texts):
        fresh = set()
        for text in texts[doc_id]:
            words = plain_words(text)
            units = plain_units(words)
            gone, seen = set(), set()
            for k in range(len(units) - run + 1):
                own = sum(units[k : k + run], [])
                key = " ".join(words[x][0] for x in own).lower()
                if key in smaller or key in seen:
                    gone |= set(own)
                seen.add(key)
            fresh |= seen
            out[doc_id, text] = [w for k, (w, _) in enumerate(words) if k not in gone]
        smaller |= fresh
    return out


def test_sentences():
    text = 'He said "go now." Then "come back." And left. ¿Qué? «Oui.» 今日は。明日も！」 ok… (Done.) هل؟ end'
    words = plain_words(text)
    got = [" ".join(words[k][0] for k in u) for u in plain_units(words)]
    assert got == ['He said "go now."', 'Then "come back."', "And left.", "¿Qué?", "«Oui.»", "今日は。", "明日も！」", "ok…", "(Done.)", "هل؟", "end"]
    starts, ends = spans.word_places(text, text.encode())
    assert [text.encode()[p:q].decode() for p, q in zip(starts, ends)] == [w for w, _ in words]
    marks = spans.span_starts(text.encode(), starts, ends, [w.lower().encode() for w, _ in words])
    assert marks.tolist() == [u[0] for u in plain_units(words)] + [len(words)]
    odd = ")" * 50_000 + " x."  # nothing but closers
    places = spans.word_places(odd, odd.encode())
    assert spans.span_starts(odd.encode(), *places, [b"a", b"b"]).tolist() == [0, 2]


def test_passages_at_random_places(spark):
    """Passages of 51 to 80 words, with and without stops, put into the middle of other texts."""
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8)))
    rows, wanted = [], {}
    for k in range(60):
        passage = [word() + ("." if k % 2 and r.random() < 0.1 else "") for _ in range(r.randrange(51, 80))]
        for copy in range(2):
            host = [word() + ("." if r.random() < 0.1 else "") for _ in range(200)]
            at = r.randrange(200)
            rows.append((2 * k + copy, " ".join(host[:at] + passage + host[at:])))
            if copy:
                wanted[2 * k + 1] = (len(passage), host)
    got = {x.doc_id: x for x in spans.drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].n_words_removed == 0 for i in range(0, 120, 2))
    share = [got[i].n_words_removed / n for i, (n, _) in wanted.items()]
    assert sum(x >= 0.5 for x in share) >= 56 and sum(share) / len(share) > 0.75
    for i, (_, host) in wanted.items():
        assert not set(host) - set(got[i].text.split())  # no word of the host is lost


def test_spans_against_brute_force(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randrange(2, 8)))
    sentence = lambda: (" ".join(word() for _ in range(r.choice([2, 4, 9, 30])))).capitalize() + r.choice([". ", "! ", "?\n", "\n", ".\t"])
    passages = ["".join(sentence() for _ in range(6)) for _ in range(3)]
    texts = []
    for _ in range(60):
        parts = [sentence() for _ in range(r.randrange(2, 20))]
        for _ in range(r.randrange(3)):
            parts.insert(r.randrange(len(parts)), r.choice(passages).upper() if r.random() < 0.3 else r.choice(passages))
        texts.append("".join(parts))
    texts += texts[:4] + [None, "", " ", "One. Two. Three.", "again. " * 40]
    rows = [(5 * i, t) for i, t in enumerate(texts)]
    rows += [rows[0], rows[7], (None, texts[0]), (None, None)]
    for more in ([], [(rows[3][0], texts[8]), (rows[3][0], texts[3] + texts[9]), (rows[40][0], texts[12])]):
        want = brute_spans(rows + more)
        frame = spark.createDataFrame([(d, t, 1, t) for d, t in rows + more], "doc_id long, text string, spans int, was string")
        got = spans.drop_repeated_spans(frame.repartition(4)).collect()
        assert Counter(x.doc_id for x in got) == Counter(d for d, _ in rows + more) and all(x.spans == 1 for x in got)
        cut = 0
        for x in got:
            if x.doc_id is not None and x.text is not None:
                assert [w.decode() for w in x.text.encode().split()] == want[x.doc_id, x.was]
                cut += x.n_words_removed
            else:
                assert x.n_words_removed == 0
        assert cut > 1000
    assert spans.drop_repeated_spans(frame.where("false")).count() == 0

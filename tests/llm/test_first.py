"""Language ID, packing, SimHash, sharding and mixing against brute force on small tables."""

import itertools
import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cuelake.llm import langid, mixing, packing, sharding, simhash
from cuelake.llm.graph import connected_components

SF = "/root/testdata/sf0.001"


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5)]
    got = dict(connected_components(spark.createDataFrame([*links, (None, 4)], "a long, b long")).collect())
    want = components({x for p in links for x in p}, links)
    assert got == {n: c for n, c in want.items() if any(n in p and p[0] != p[1] for p in links)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover(radius):
    masks = simhash.covering_masks(radius)
    for bits in itertools.combinations(range(0, 64, 5), radius):
        assert any(not any(m >> b & 1 for b in bits) for m in masks)


def fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [words[k : k + 3] for k in range(len(words) - 2)] or ([words] if words else [])
    total = Counter()
    for run in runs:
        h = xxhash.xxh64_intdigest(b" ".join(run), 42)
        total.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in total.items() if 2 * n > len(runs))


def test_simhash_against_all_pairs(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdé") for _ in range(4))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(400)]
        for _ in range(6):
            copy = base[:]
            for _ in range(r.randrange(3)):
                copy[r.randrange(400)] = word()
            texts.append(" ".join(copy))
    texts += [None, "", " \n", "one", "One", "one two", "x" * 300_000, *texts[:3]]
    rows = [(i, t, "src", None) for i, t in enumerate(texts)] + [(3, texts[3], None, "z")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string, fp string")).collect()
    prints = [fingerprint(t) for _, t, *_ in rows]
    ids = [x[0] for x in rows]
    links = [(ids[a], ids[b]) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = components(set(ids), links)
    assert len(set(want.values())) < len(set(prints)) < len(rows)
    assert sorted((d, fp & (1 << 64) - 1, c) for d, fp, c in got) == sorted((i, p, want[i]) for i, p in zip(ids, prints, strict=True))
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    nameless = simhash.near_duplicates(spark.createDataFrame([(None, "a b c"), (4, "a b c"), (None, "q")], "doc_id long, text string")).collect()
    assert Counter((x.doc_id, x.component_id) for x in nameless) == Counter([(None, 4), (4, 4), (None, None)])


def test_langid(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).collect()
    truth = dict(docs.select("doc_id", "lang").collect())
    own = [x for x in got if x.held_out]
    assert len(got) == docs.count() and 0.1 < len(own) / len(got) < 0.3
    assert sum(truth[x.doc_id] == x.lang_pred for x in own) / len(own) > 0.9
    odd = spark.createDataFrame([(1, None, "en", 1), (2, "", "en", 1), (3, "12 ?!", None, 1), (None, "the", "en", 1), (6, "der" * 500_000, "de", 1), (7, "the of and", "en", 1), (8, "der die das", "de", 1)], "doc_id long, text string, lang string, lang_pred int")
    rows = {x.doc_id: x for x in langid.identify(odd).collect()}
    assert [rows[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and rows[1].score == 0
    assert rows[None].held_out and rows[None].lang_pred in ("en", "de")
    assert all(0 <= x.score <= 1 for x in rows.values())
    assert langid.identify(odd.where("false")).count() == 0
    assert {x.lang_pred for x in langid.identify(odd.withColumn("lang", odd.lang.substr(9, 1).try_cast("int").cast("string"))).collect()} == {"und"}


def plain_grams(text, buckets):
    """Hashed 1- to 3-grams of one text, letter by letter."""
    kind = lambda c: unicodedata.category(c)[0]
    low = lambda c: (ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if kind(c) in "LM" else 32
    m = 2**32
    out = []
    for k, c in enumerate(text):
        if kind(c) == "L":
            one, before, after = low(c), low(text[k - 1]) if k else 32, low(text[k + 1]) if k + 1 < len(text) else 32
            for h in (one * 0x9E3779B1, before * 0x85EBCA6B % m ^ one * 0xC2B2AE35 % m, before * 0x27D4EB2F % m ^ one * 0x165667B1 % m ^ after * 0xD3A2646D % m):
                h %= m
                out.append((((h ^ h >> 15) * 0x2C1B3C6D % m) >> 12) % buckets)
    return out


def test_ngrams_of_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(langid, "CHARS_AT_ONCE", 7)
    texts = ["Écoute la mer, कि 12 straße", None, "", "\u0301\u0301", "a", "abcdefg" * 3, "İstanbul"]
    got = [[] for _ in texts]
    for rows, starts, ids in langid.ngrams(texts):
        for row, a, b in zip(rows, starts, [*starts[1:], len(ids)], strict=True):
            got[row] += ids[a:b].tolist()
    assert got == [plain_grams(t or "", langid.BUCKETS) for t in texts]


def test_langid_against_plain_counts(spark):
    """Labels and scores of every row, with marks, ties and repeated rows."""
    r = random.Random(8)
    words = {"aa": "der die das und ist", "bb": "the of and to in", "cc": "е́ в на не что", "dd": "the of and to in"}
    rows = []
    for i in range(160):
        lang = r.choice(list(words))
        rows.append((i, " ".join(r.choice(words[lang].split() + ["x1", "Éa", "कि"]) for _ in range(r.randrange(1, 60))), lang if i % 7 else None))
    rows += [rows[0], rows[0], (500, "\u0301\u0301 \u0301", "aa"), (501, None, "bb"), (502, "12 3", None), (503, "q", None)]
    got = Counter((x.doc_id, x.held_out, x.lang_pred, round(x.score, 6)) for x in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect())
    counts, texts = {}, Counter()
    for i, t, lang in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 5:
            counts.setdefault(lang, Counter()).update(plain_grams(t or "", langid.BUCKETS))
            texts[lang] += 1
    want = Counter()
    for i, t, _ in rows:
        own = plain_grams(t or "", langid.BUCKETS)
        logs = {k: (sum(math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * langid.BUCKETS)) for g in own), math.log(texts[k] / sum(texts.values()))) for k, c in sorted(counts.items())}
        if own:
            best = max(sorted(logs), key=lambda k: round(sum(logs[k]), 3))
            p = {k: ll + prior for k, (ll, prior) in logs.items()}
            label, score = best, 1 / sum(math.exp(x - p[best]) for x in p.values())
        else:
            label, score = "und", 0.0
        want[i, zlib.crc32(str(i).encode()) % 5 == 0, label, round(score, 6)] += 1
    label = lambda c: Counter({(i, h, x): n for (i, h, x, _), n in c.items()})
    assert label(got) == label(want)
    score = lambda c: sorted((i, s) for i, _, _, s in c)
    assert all(abs(x[1] - y[1]) < 1e-3 for x, y in zip(score(got), score(want), strict=True))


def test_hilbert_is_a_walk():
    for dims, bits in ((2, 3), (3, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = packing.hilbert_index(cells, bits)
        path = cells[np.argsort(keys)]
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [(i, t, "x") for i, t in enumerate(x.text for x in spark.read.parquet(f"{SF}/documents.parquet").collect())]
    rows += [(9000, None, "x"), (9001, "", "x"), (9002, "İSTANBUL Àb\tc\r\n d's <|endoftext|> x", "x"), (9003, "word " * 30_000, "x"), (None, "no id", "x"), (7, "again", "y")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, ids string"), length=256, ranges=3).collect()
    coder = Tokenizer.from_file(packing.vocabulary())
    want = Counter((d, tuple([*coder.encode(t or "", add_special_tokens=False).ids, 1])) for d, t, _ in rows)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in got:
        by_doc[p.doc_id, p.doc_tokens].append(p)
        by_seq[p.sequence_id].append((p.offset, len(p.ids) // 4))
    seen = Counter()
    for (d, n), ps in by_doc.items():
        ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in sorted(ps, key=lambda p: p.start)])
        assert len(ids) == n
        seen[d, tuple(ids.tolist())] += 1
    assert seen == want
    for ps in by_seq.values():
        at = 0
        for offset, n in sorted(ps):
            assert offset == at and n > 0
            at += n
        assert at <= 256 and at & (at - 1) == 0
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sharding(spark):
    names = [f"s{k}" for k in range(7)]
    full = sharding.fill_table(names, 211)
    assert max(Counter(full).values()) - min(Counter(full).values()) <= 1
    fewer = sharding.fill_table(names[:-1], 211)
    assert sum(a != b for a, b in zip(full, fewer, strict=True) if a != 6) < 211 / 4
    docs = spark.createDataFrame([(1, "a", "old"), (1, "b", "old"), (None, None, None)], "doc_id long, text string, shard string")
    rows = sharding.place(docs, names, 211).collect()
    assert len(rows) == 3 and len({x.slot for x in rows if x.doc_id == 1}) == 1 and all(x.shard_name == names[x.shard] for x in rows)
    assert sharding.place(docs.where("false"), names, 211).count() == 0
    with pytest.raises(ValueError):
        sharding.fill_table(names, 210)


def test_mixing(spark):
    rows = [(i, "w " * 5, "hot") for i in range(900)] + [(1000 + i, "w w", "small") for i in range(100)] + [(2000, "w w w", None), (2001, "", "empty"), (None, "w", "small"), (1000, "w w", "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mixing_plan(docs, max_repetition=1.5, whole=True)
    got = mixing.mix(docs, plan).collect()
    once = Counter((x.doc_id, x.source) for x in got if x.block == 0)
    assert once == Counter((d, s) for d, _, s in rows if s != "empty")
    assert {x.block for x in got} <= {0, 1}
    used = Counter()
    for x in got:
        used[x.source] += len(x.text.split())
    for p in plan.collect():
        assert p.budget <= used[p.source] < p.budget + 10 * p.tokens and used[p.source] / p.tokens <= 1.5 * 1.2 + 3
    even = {p.source: p for p in mixing.mixing_plan(docs, entropy_share=0.9).collect()}
    h = -sum(p.weight * np.log(p.weight) for p in even.values()) / np.log(3)
    assert 0.9 - 1e-5 < h < 0.91 and abs(sum(p.weight for p in even.values()) - 1) < 1e-9
    assert even["hot"].full_blocks == 0 and even["small"].full_blocks >= 1
    none = docs.where("false")
    assert mixing.mix(none, mixing.mixing_plan(none, entropy_share=0.9)).count() == 0


def test_mixing_takes_columns_of_any_name(spark):
    rows = [(i, f"s{i % 3}", "w " * (i + 1), i, -i, "k", 7) for i in range(40)] + [(None, None, None, 0, 0, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, full_blocks int, cut_key int, __uses string, block int").withColumns({"__source": F.lit(1), "row": F.lit(2), "key": F.lit(3), "of": F.lit(4), "a.b": F.lit(5)})
    plan = mixing.mixing_plan(df, entropy_share=0.9)
    got = mixing.mix(df, plan).collect()
    want = mixing.mix(df.select("doc_id", "source", "text"), plan).collect()
    assert sorted((x.doc_id, x.block) for x in got) == sorted((x.doc_id, x.block) for x in want)
    assert all((x.full_blocks, x.cut_key, x["__uses"], x["__source"], x.row, x.key, x.of, x["a.b"]) == (x.doc_id, -x.doc_id, "k", 1, 2, 3, 4, 5) for x in got)
    kept = mixing.mix(df, plan, block_col="use").collect()
    assert all(x.block == 7 for x in kept) and len(kept) == len(got)

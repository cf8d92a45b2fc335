"""Near-dedup by shingle similarity against comparing all pairs."""

import random

import numpy as np
from pyspark.sql import Row

from cuelake.llm import neardup
from tests.llm.test_pipeline import plain_groups


def check(spark, texts):
    rows = [Row(doc_id=i, text=t) for i, t in enumerate(texts)]
    got = {x.doc_id: x.group_id for x in neardup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = plain_groups(rows)
    assert got == {i: want[i] for i in got} and len(got) == len(rows)
    return sum(i != g for i, g in got.items())


def words(r, n):
    return [f"w{r.randrange(100_000)}" for _ in range(n)]


def changed(r, own, n):
    out = list(own)
    for k in r.sample(range(5, len(own) - 5), n):
        out[k] = f"x{r.randrange(100_000)}"
    return out


def test_texts_of_the_same_words_and_crowds(spark):
    """Other orders of the same words stand before a text that has a near copy; one passage is in all texts of a crowd."""
    r = random.Random(21)
    texts = []
    for _ in range(15):
        own = words(r, 200)
        texts += [r.sample(own, len(own)) for _ in range(6)] + [own, changed(r, own, 4)]
    passage = words(r, 90)
    for _ in range(40):
        own = passage + words(r, 30)
        texts += [own, changed(r, own, 1)]
    base = words(r, 150)
    texts += [changed(r, base, 3) for _ in range(40)] + [base]
    assert check(spark, [" ".join(t) for t in texts]) >= 15 + 40 + 40


def test_cut_and_lengthened_copies(spark):
    """Copies without their end, with a strange footer or header, down to a similarity of 0.8."""
    r = random.Random(22)
    texts = []
    for k in range(40):
        own, other = words(r, 200), words(r, 40)
        cut = [20, 38, 39, 60][k % 4]
        texts += [own, own[:-cut], own + other[:cut], other[: cut // 2] + own]
    assert check(spark, [" ".join(t) for t in texts]) >= 80


def test_long_texts_that_share_a_passage_are_no_candidates(spark, monkeypatch):
    """Their short bitmaps are full, so what they share of their prefixes tells them apart; a true pair at 0.8 still is one, of different sizes too."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    monkeypatch.setattr(neardup, "common_shingles", lambda *_: none)  # no shingle is known to be common
    r = random.Random(24)
    passage = words(r, 80)
    texts = [words(r, r.randrange(1300, 1700)) + passage for _ in range(40)]
    own = words(r, 1500) + passage
    texts += [own, changed(r, own, 32), own[:-300], words(r, 300) + own]
    rows = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    prints = neardup.word_prints(rows).withColumnRenamed("doc_id", "rep").cache()
    met = neardup.crowded(neardup.buckets(prints))
    nothing = spark.createDataFrame([], "node long, component long"), spark.createDataFrame([], "a long, b long")
    found = {(x.a, x.b) for x in neardup.other_candidates(met, prints, *nothing).collect()}
    sets = [neardup.shingles_of(" ".join(t).encode().split(), neardup.WIDTH) for t in texts]
    alike = {(a, b) for a in range(len(texts)) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
    assert len(alike) >= 3 and alike <= found and len(found) <= len(alike) + 10
    every = spark.createDataFrame([(a, b) for a in range(len(texts)) for b in range(a)], "a long, b long")
    assert alike <= {(x.a, x.b) for x in neardup.within(every, prints).collect()} <= alike | {(a, b) for a in range(40, 44) for b in range(40, a)}


def test_wide_bitmaps_bound_the_difference(spark):
    r = np.random.default_rng(25)
    some = r.integers(0, 1 << 63, 6000).astype(np.uint64) * np.uint64(2) + r.integers(0, 2, 6000).astype(np.uint64)
    x, y = np.unique(some[:4000]), np.unique(some[200:4200])  # of one size and of two
    assert len(neardup.wide_parity(x[: neardup.MANY])) == 0
    for a, b in ((x, y), (x, y[:3800]), (np.unique(some[:5000]), x), (np.unique(some), x)):
        rows = spark.createDataFrame([(neardup.wide_parity(a).tolist(), neardup.wide_parity(b).tolist())] * 2, "x array<bigint>, y array<bigint>")
        for p, q in ("xy", "yx"):
            got = rows.select(neardup._apart_wide(rows[p], rows[q])).first()[0]
            assert 0 < got <= len(np.setxor1d(a, b))


def test_texts_of_one_id_are_documents_of_their_own(spark):
    r = random.Random(23)
    x, b, c = (words(r, 100) for _ in range(3))
    texts = [(1, x), (2, changed(r, x, 2)), (2, b), (3, changed(r, b, 2)), (4, c), (4, changed(r, c, 1)), (5, changed(r, c, 2)), (6, c), (6, c), (None, x), (7, None), (7, words(r, 9))]
    rows = [(i, None if t is None else " ".join(t), k, "v") for k, (i, t) in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int, row string")
    kept = neardup.keep_one(df).collect()
    assert sorted(y.node for y in kept if y.doc_id != 4) == [0, 2, 9, 10, 11]
    assert sum(y.doc_id == 4 for y in kept) == 1 and kept[0].row == "v"
    plain = neardup.keep_one(df.where("node not in (1, 5, 10)")).collect()
    assert sorted(y.node for y in plain) == [0, 2, 4, 9, 11]

"""Spelling variants against all pairs of words, and the words against a plain loop."""

import random
import re
import zlib
from collections import Counter

import pytest

from cuelake.llm import spelling


def near(x, y):
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return any(x == y[:i] + y[i + 1 :] for i in range(len(y)))


def plain_words(docs, every, length=7, least=2):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= length and c >= least}


def plain_variants(n, factor):
    links = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in links.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n[w], len(links[w]), form[w], n.get(form[w]), root))
    return out


def rows(df):
    return sorted(df.select("word", "n", "n_near", "form", "form_n", "root").collect())


@pytest.mark.parametrize("alphabet,lengths,count,subtrie", [("ab", (7, 9), 250, 10_000), ("abcé", (7, 10), 400, 30), ("eainrtoslÿÀ", (7, 8), 400, 100), ("ab", (8, 8), 256, 5)])
def test_equals_all_pairs(spark, alphabet, lengths, count, subtrie):
    rng = random.Random(count)
    n = {}
    while len(n) < count and len(n) < len(alphabet) ** lengths[1] * 0.8:
        word = "".join(rng.choice(alphabet) for _ in range(rng.randint(*lengths)))
        n[word] = int(2 + 10 ** rng.uniform(0, 5))
        i = rng.randrange(len(word))
        n[word[:i] + rng.choice(alphabet) + word[i + rng.randrange(2) :]] = int(2 + 10 ** rng.uniform(0, 5))
    out = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n bigint"), factor=3, subtrie=subtrie)
    assert {tuple(r) for r in rows(out)} == plain_variants(n, 3) and len(rows(out)) == len(n)


def test_whole_texts(spark):
    rng = random.Random(3)
    base = ["Somewhere", "somewhat", "différent", "DIFFÉRENT", "anything", "everything", "×÷letters", "thinking", "thanking"]
    docs = [(i, " ".join(rng.choice(base) + rng.choice([",", ".", "ł", "7", "\n", "中", "-"]) for _ in range(rng.randrange(80)))) for i in range(120)]
    docs += [(5, docs[5][1]), (None, "Somewhere " * 40), (901, None), (902, ""), (903, "short 123 中文"), (904, "x" * 300_000 + " " + "x" * 300_000), (905, "x" * 300_001 + "," + "x" * 300_001)]
    n = plain_words(docs, 31)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "text as word", "doc_id as n", "text as form")
    assert {r.word: r.n for r in spelling.vocabulary(df, every=31).collect()} == n
    out = spelling.spelling_variants(df, every=31)
    assert {tuple(r) for r in rows(out)} == plain_variants(n, 10)
    assert spelling.vocabulary(df, 3, 1).where("word = 'short'").count() == 1


def test_long_chains_and_empty(spark):
    words = ["abcdefg" + "h" * k for k in range(12)]
    n = {w: 3 * 2**k for k, w in enumerate(words)}
    out = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n bigint"), factor=2)
    assert {r.root for r in out.collect()} == {words[-1]}
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "word string, n bigint"), factor=1)

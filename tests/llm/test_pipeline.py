"""Each stage of the pipeline on its own input, against plain versions, and run() as a whole."""

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from cuelake.llm import langid, packing
from tests.llm.test_first import components
from tests.llm.test_repeats import brute_spans, plain_words

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    """Documents of the smallest table, with copies, near copies, a shared passage, and texts without letters."""
    r = random.Random(12)
    rows = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(80).collect()]
    passage = ". ".join(" ".join(f"p{k}{j}q" for j in range(9)) for k in range(7)) + ".\n"
    extra = []
    for i, (_, t, lang, source, _) in enumerate(rows[:24]):
        if len(t.split()) < 80:
            continue
        words = t.split(" ")
        if i % 3 == 1:
            words[len(words) // 2] = "changedword"
        text = passage + t[::-1] if i % 3 == 2 else " ".join(words)
        extra.append((5000 + i, text, lang, source, len(text)))
    extra += [(6000, None, "en", "src0", 0), (6001, "12 34 !!", "en", "src0", 8), (6002, "", None, None, 0), (6003, rows[0][1], None, None, 5), rows[3]]
    mixed = rows + extra
    r.shuffle(mixed)
    return spark.createDataFrame(mixed, FIELDS)


def plain_language(docs):
    """Naive Bayes with dictionaries of counts, over the same n-grams."""
    def grams(text):
        return [g for _, _, ids in langid.ngrams([text]) for g in ids.tolist()]

    counts, texts = {}, Counter()
    for d in docs:
        if d.lang is not None:
            counts.setdefault(d.lang, Counter()).update(grams(d.text))
            texts[d.lang] += 1
    langs = sorted(counts)
    keep = set()
    for d in docs:
        own = Counter(grams(d.text))
        n = sum(own.values())
        if not n:
            continue
        logs = []
        for k in langs:
            total = sum(counts[k].values()) + 0.5 * langid.BUCKETS
            ll = sum(c * np.log((counts[k][g] + 0.5) / total) for g, c in own.items())
            prior = np.log(texts[k] / sum(texts.values()))
            logs.append(ll + prior)
        p = np.exp(np.array(logs) - max(logs))
        if p[int(np.argmax(logs))] / p.sum() >= corpus_pipeline.MIN_SCORE:
            keep.add(d.doc_id)
    return keep


def plain_groups(docs):
    """Components of five-word shingle similarity of 0.8, by comparing all pairs."""
    sets = {}
    for d in docs:
        w = (d.text or "").encode().lower().split()
        sets[d.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    return components(ids, links)


def test_stages(spark, tmp_path):
    docs = documents(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / str(k)))
        after_frame = spark.read.parquet(str(tmp_path / str(k)))
        after = after_frame.collect()
        if k < 4:
            assert after_frame.columns == docs.columns
        if k == 0:
            keep = plain_language(before)
            assert Counter(d.doc_id for d in after) == Counter(d.doc_id for d in before if d.doc_id in keep)
            assert not {6000, 6001, 6002} & keep and len(keep) > 80
        elif k == 1:
            group = plain_groups(before)
            assert Counter(d.doc_id for d in after) == Counter(d.doc_id for d in before if group[d.doc_id] == d.doc_id)
            assert len(after) < len(before) - 5
        elif k == 2:
            want = {i: w for (i, _), w in brute_spans([(d.doc_id, d.text) for d in before]).items() if w}
            assert {d.doc_id: [w for w, _ in plain_words(d.text)] for d in after} == want
            assert sum(d.n_chars for d in after) < sum(len(d.text) for d in before) and all(d.n_chars == len(d.text) for d in after)
        elif k == 3:
            uses, once = Counter(d.doc_id for d in after), Counter(d.doc_id for d in before)
            assert set(uses) == set(once) and all(once[i] <= uses[i] <= 2 * once[i] for i in once)
        else:
            total = Counter()
            for p in after:
                total[p.doc_id] += len(p.ids) // 4
            encode = packing.tokenizer(packing.vocabulary())
            want = Counter()
            import pyarrow as pa

            for d in before:
                want[d.doc_id] += len(encode(pa.array([d.text]))[0]) + 1
            assert total == want
        docs = after_frame


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.groupBy("sequence_id").agg({"offset": "count"}).collect()
    assert out.columns == ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"] and len(rows) > 3
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "substring dedup", "mixing", "packing"]
    none = spark.createDataFrame([], FIELDS)
    for _, stage in corpus_pipeline.STAGES:
        result = stage(spark, none, "")
        assert result.count() == 0

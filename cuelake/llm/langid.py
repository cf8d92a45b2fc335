"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are summed in each task as one array a language, so what is shuffled is bounded by
tasks x languages x buckets.  The log-probability matrix (languages x buckets, its size is
checked) is broadcast, and a batch of texts is scored in numpy as one sparse product: the
bucket of each n-gram picks a column and the columns are summed between text boundaries.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import arrow_schema, batch_of, slices

BUCKETS, CHARS_AT_ONCE, MAX_MODEL_MB, UNKNOWN = 1 << 16, 1 << 18, 256, "und"


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: the lower-case letter or the mark, or a space for all else; and whether it is a letter."""
    out, letter = np.full(0x110000, 32, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        ch = chr(c)
        kind = unicodedata.category(ch)[0]
        if kind in "LM":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
            letter[c] = kind == "L"
    return out, letter


def _pieces(texts: list[str | None]) -> list[tuple[int, str, int, int]]:
    """(row, text, from, to) of the batch; a very long text comes as several pieces that know a character of their neighbours."""
    out = []
    for i, t in enumerate(texts):
        for k in range(0, len(t or ""), CHARS_AT_ONCE):
            low = max(0, k - 1)
            part = t[low : k + CHARS_AT_ONCE + 1]
            out.append((i, part, k - low, min(len(part), k - low + CHARS_AT_ONCE)))
    return out


def ngrams(texts: list[str | None], buckets: int = BUCKETS):
    """Yields (rows, starts, ids): the hashed 1- to 3-grams of letters, those of rows[i] from starts[i] on.

    Each letter gives itself, the pair with what stands before it and the three with what stands after it,
    where a mark stands for itself and all else for a space.
    """
    lower, letter = _letters()
    pieces = _pieces(texts)
    for a, b in slices((t for _, t, _, _ in pieces), CHARS_AT_ONCE):
        part = pieces[a:b]
        raw = np.frombuffer((" " + " ".join(t for _, t, _, _ in part) + " ").encode("utf-32-le", "replace"), np.uint32)
        ends = np.cumsum([len(t) + 1 for _, t, _, _ in part])
        counted = letter[raw]
        for (_, t, first, last), end in zip(part, ends.tolist(), strict=True):
            begin = end - len(t)
            counted[begin : begin + first] = False
            counted[begin + last : end] = False
        codes = lower[raw]
        at = np.flatnonzero(counted)
        if not len(at):
            continue
        one, before, after = codes[at], codes[at - 1], codes[at + 1]
        with np.errstate(over="ignore"):
            mixed = [one * np.uint32(0x9E3779B1), (before * np.uint32(0x85EBCA6B)) ^ (one * np.uint32(0xC2B2AE35)), (before * np.uint32(0x27D4EB2F)) ^ (one * np.uint32(0x165667B1)) ^ (after * np.uint32(0xD3A2646D))]
            ids = np.stack([((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(12)) % np.uint32(buckets) for h in mixed], axis=1).ravel()
        counts = np.diff(np.searchsorted(at, np.concatenate([[0], ends + 1])))
        has = np.flatnonzero(counts)
        starts = 3 * np.concatenate([[0], np.cumsum(counts[has])[:-1]])
        yield np.array([part[i][0] for i in has]), starts, ids


def _count(buckets: int):
    schema = arrow_schema("lang string,bucket int,n long")

    def run(batches):
        sums: dict[str, np.ndarray] = {}

        def flush():
            for lang, x in sums.items():
                at = np.flatnonzero(x)
                yield batch_of(schema, lang=[lang] * len(at), bucket=at.astype(np.int32), n=x[at])
            sums.clear()

        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                x = sums.setdefault(lang, np.zeros(buckets + 1, np.int64))
                own = [t for t, k in zip(texts, langs, strict=True) if k == lang]
                x[buckets] += len(own)  # the last place counts texts
                for _, _, ids in ngrams(own, buckets):
                    x[:buckets] += np.bincount(ids, minlength=buckets)
            if len(sums) > 64:
                yield from flush()
        yield from flush()

    return run


class Model:
    """Sorted languages and their log probabilities, one column a bucket and the prior last."""

    def __init__(self, langs: list[str], logp: np.ndarray):
        self.langs, self.logp = langs, logp


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS, alpha: float = 0.5) -> Model:
    """Fit on every labelled row (a null language is not a label); no sample is taken."""
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = rows.mapInArrow(_count(buckets), "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_lang = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("x"))
    langs = sorted(r[0] for r in labelled.where(F.col(lang_col).isNotNull()).select(lang_col).distinct().limit(int(MAX_MODEL_MB * 2**20 / 4 / buckets) + 1).collect())
    if len(langs) * buckets * 4 > MAX_MODEL_MB * 2**20:
        raise ValueError(f"a model of more than {MAX_MODEL_MB} MB: lower buckets or merge languages")
    total = np.zeros((len(langs), buckets + 1))
    at = {x: i for i, x in enumerate(langs)}
    for lang, pairs in by_lang.toLocalIterator():
        cells = np.array(pairs, np.int64).reshape(-1, 2)
        total[at[lang], cells[:, 0]] = cells[:, 1]
    if not langs:
        return Model([], np.zeros((0, buckets + 1), np.float32))
    grams, texts = total[:, :buckets] + alpha, total[:, buckets:]
    return Model(langs, np.hstack([np.log(grams / grams.sum(axis=1, keepdims=True)), np.log(texts / texts.sum())]).astype(np.float32))


def score_batch(texts: list[str | None], langs: list[str], logp: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text, ties to the first by name, and its posterior."""
    buckets = logp.shape[1] - 1
    sums, grams = np.zeros((len(langs), len(texts))), np.zeros(len(texts))
    for rows, starts, ids in ngrams(texts, buckets):
        np.add.at(grams, rows, np.diff(np.append(starts, len(ids))))
        for k in range(len(langs)):
            np.add.at(sums[k], rows, np.add.reduceat(logp[k][ids], starts, dtype=np.float64))
    known = grams > 0
    if not langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    logs = sums + logp[:, buckets:]
    best = logs.argmax(axis=0)
    share = np.exp(logs - logs.max(axis=0))
    share = share[best, np.arange(len(texts))] / share.sum(axis=0)
    return [langs[i] if ok else UNKNOWN for i, ok in zip(best, known, strict=True)], np.where(known, share, 0.0)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and lang_score, its posterior given the whole text (columns of these names are replaced).

    A null text, or one without a letter, is ``und`` with score 0, as is every text if no language was learned.
    Whole texts are scored; only ``text_col`` is looked at.
    """
    kept = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.logp))
    at = kept.columns.index(text_col)

    def run(batches):
        for b in batches:
            langs, scores = [], []
            texts = b.column(at)
            for start in range(0, b.num_rows, 512):
                k, s = score_batch(texts.slice(start, 512).to_pylist(), *shared.value)
                langs += k
                scores.append(s)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*b.schema.names, "lang_pred", "lang_score"])

    schema = kept.selectExpr("*", "cast(null as string) lang_pred", "cast(null as double) lang_score").schema
    return kept.mapInArrow(run, schema)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text falls in fold 0; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(True))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the folds that are not held out, predicted for every row."""
    model = train(docs.where(~held_out(F.col(id_col))), text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return predict(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))

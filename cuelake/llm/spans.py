"""Substring dedup by sliding sentence spans.

A sentence ends at a full stop of any script, with the quotes and brackets that close behind it, or at a line
feed.  Long sentences are made of phrases: one opens at a word whose hash is the least of the seven
around it, all in the sentence.  Words decide that, not places, so a passage that was put into the middle of another
sentence, or holds no stop, falls into the same phrases in each document.  Every run of ``run`` consecutive sentences
or phrases is hashed (128 bits, case and white space folded).  A run that also stands earlier (smaller doc_id, or
earlier in the document) is a repeat, and the sentences and phrases that a repeat covers are removed.  Runs
are compared on the input, not on what is left.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from cuelake.llm.common import arrow_schema, as_row, batch_of, with_variant

RUN, HALF, ROWS_OUT = 4, 3, 200_000
#: characters that end a sentence, those of scripts without spaces, and those that may follow
STOPS, WIDE, CLOSERS = ".!?\u2026\u061f\u06d4\u0964\u0965\u0589\u1362\u1367\u3002\uff01\uff1f\uff61", "\u3002\uff01\uff1f\uff61", "\"')]}\u2019\u201d\u00bb\u203a\u300d\u300f\u3011\uff09"
_SPACE, _ENDS, _CLOSES = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ENDS[list(b".!?")] = True
_CLOSES[list(b"\"')]}")] = True
_HAS_WIDE = re.compile(f"[{WIDE}]")
_WIDE_WORD = re.compile(f"[^\t-\r {WIDE}]*[{WIDE}]+[{re.escape(CLOSERS)}]*|[^\t-\r {WIDE}]+")


def word_places(text: str, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which each word starts and ends; words are parted by ASCII white space and behind the stops of scripts without spaces."""
    if _HAS_WIDE.search(text):
        found = np.array([m.span() for m in _WIDE_WORD.finditer(text)], np.int64).reshape(-1, 2)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        places = np.concatenate([[0], np.cumsum(sizes)])[found]
        return places[:, 0], places[:, 1]
    space = np.concatenate([[True], _SPACE[np.frombuffer(raw, np.uint8)], [True]])
    turns = np.flatnonzero(space[1:] != space[:-1])
    return turns[::2], turns[1::2]


def _closing(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each word ends a sentence by its last characters."""
    a = np.frombuffer(raw, np.uint8)
    at = ends - 1
    for _ in range(4):
        at = at - (_CLOSES[a[at]] & (at > starts))
    out = _ENDS[a[at]]
    for k in np.flatnonzero((a[at] >= 128) | _CLOSES[a[at]]):
        last = raw[starts[k] : ends[k]].decode("utf-8", "replace").rstrip(CLOSERS)[-1:]
        out[k] = last != "" and last in STOPS
    return out


def span_starts(raw: bytes, starts: np.ndarray, ends: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Numbers of the words that open a sentence or a phrase, and the number of words; ``words`` are case-folded."""
    n = len(starts)
    if not n:
        return np.zeros(1, np.int64)
    lines = np.cumsum(np.frombuffer(raw, np.uint8) == 10)
    opens = np.ones(n, bool)
    opens[1:] = _closing(raw, starts[:-1], ends[:-1]) | (lines[starts[1:]] > lines[ends[:-1] - 1])
    if n > 2 * HALF:
        own = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
        hashes = np.fromiter(map(zlib.crc32, words), np.uint32, n) * np.uint32(0x9E3779B1)
        near = np.lib.stride_tricks.sliding_window_view(hashes, 2 * HALF + 1)
        middle = hashes[HALF : n - HALF]
        least = (middle < near[:, :HALF].min(axis=1)) & (middle <= near[:, HALF + 1 :].min(axis=1))
        opens[HALF : n - HALF] |= least & (own[: n - 2 * HALF] == own[2 * HALF :])
    return np.append(np.flatnonzero(opens), n)


def runs_of(text: str, run: int = RUN):
    """Yields (hash high, hash low, first word, end word) of each run of sentences and phrases of ``text``."""
    raw, folded = text.encode(), text.lower()
    starts, ends = word_places(text, raw)
    lower = folded.encode()
    words = [lower[p:q] for p, q in zip(*(x.tolist() for x in word_places(folded, lower)), strict=True)]
    marks = span_starts(raw, starts, ends, words)
    if len(marks) <= run:
        return
    to = np.cumsum([len(w) + 1 for w in words])
    line = b" ".join(words)
    first, end = marks[:-run], marks[run:]
    begin = np.concatenate([[0], to])[first]
    for a, b, p, q in zip(first.tolist(), end.tolist(), begin.tolist(), (to[end - 1] - 1).tolist(), strict=True):
        h = xxhash.xxh3_128_intdigest(line[p:q])
        yield (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), a, b


def _block(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Runs of some texts; those that are not the first of their block are ``known`` repeats under a hash of their own."""
    h1, h2, doc_id, variant, first, last = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    order = np.lexsort((first, variant, doc_id, h2, h1))
    h1, h2, doc_id, variant, first, last = (x[order] for x in (h1, h2, doc_id, variant, first, last))
    opens = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    texts = opens | np.concatenate([[True], (doc_id[1:] != doc_id[:-1]) | (variant[1:] != variant[:-1])])
    head, own_head = (np.flatnonzero(x)[np.cumsum(x) - 1] for x in (opens, texts))
    known = (doc_id != doc_id[head]) | (first != first[own_head])
    with np.errstate(over="ignore"):
        own = (doc_id * np.int64(0x1E3779B97F4A7C15)) ^ (first * np.int64(0x3F58476D1CE4E5B9)) ^ variant
    return batch_of(schema, h1=np.where(known, own, h1), h2=np.where(known, doc_id, h2), doc_id=doc_id, variant=variant, first=first, last=last, known=known)


def spans(docs: DataFrame, run: int = RUN) -> DataFrame:
    """(h1, h2, doc_id, variant, first, last, known): every run of every document, as word numbers first <= x < last.

    ``docs`` needs doc_id, text and variant.  Of equal runs in a block of texts only the first has to meet those of other
    blocks, so a run that a third of the documents share is dealt over all tasks.
    """
    schema = arrow_schema("h1 long,h2 long,doc_id long,variant long,first int,last int,known boolean")

    def rows(batches):
        out: list[tuple] = []
        for b in batches:
            for doc_id, text, variant in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                for x in runs_of(text.as_py(), run):
                    out.append((x[0], x[1], doc_id, variant, x[2], x[3]))
                if len(out) >= ROWS_OUT:
                    yield _block(out, schema)
                    out = []
        if out:
            yield _block(out, schema)

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text", "variant").mapInArrow(rows, "h1 bigint, h2 bigint, doc_id bigint, variant bigint, first int, last int, known boolean")


def repeated(runs: DataFrame) -> DataFrame:
    """(doc_id, variant, spans): the runs of each text that also stand under a smaller doc_id, or earlier in the text itself.

    One shuffle by hash, in which a run has at most one row for each block of ``ROWS_OUT`` runs and text of its smallest id.
    """
    order = Window.partitionBy("h1", "h2").orderBy("doc_id", "variant", "first")
    own = Window.partitionBy("h1", "h2", "doc_id", "variant").orderBy("first")
    placed = runs.withColumn("lead", F.first("doc_id").over(order)).withColumn("own", F.first("first").over(own))
    return placed.where("known or doc_id > lead or first > own").groupBy("doc_id", "variant").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def covered(n: int, spans_: list[tuple[int, int]]) -> np.ndarray:
    """Which of ``n`` places lie in one of the half-open spans."""
    edge = np.zeros(n + 1, np.int64)
    if len(spans_):
        s = np.asarray(spans_, np.int64)
        np.add.at(edge, s[:, 0], 1)
        np.add.at(edge, s[:, 1], -1)
    return np.cumsum(edge)[:n] > 0


def cut_words(text: str, spans_: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the words in the spans (each with the white space after it), words cut, and pieces cut."""
    raw = text.encode()
    starts, _ = word_places(text, raw)
    gone = covered(len(starts), [(a, min(b, len(starts))) for a, b in spans_ if a < len(starts)])
    upto = np.append(starts[1:], len(raw))
    keep = np.ones(len(raw) + 1, bool)
    turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    for a, b in zip(turns[::2], turns[1::2], strict=True):
        keep[starts[a] : upto[b - 1]] = False
    kept = np.frombuffer(raw, np.uint8)[keep[:-1]].tobytes().decode()
    return kept, int(gone.sum()), len(turns) // 2


def drop_repeated_spans(docs: DataFrame, run: int = RUN) -> DataFrame:
    """``docs`` with its text cut, and n_words_removed and n_pieces_removed (bigint; replaced if present).

    ``docs`` needs doc_id (bigint) and text; other columns are kept, whatever their names.  Rows without an id or a text are
    returned as they are and are nobody's first.  Rows of equal id are documents of their own, none earlier than another:
    each loses what stands under a smaller id or earlier in itself.  A text of nothing but repeats becomes ''.
    """
    new = ("n_words_removed", "n_pieces_removed")
    kept = [c for c in docs.columns if c not in new]
    rows = with_variant(docs.select(as_row(docs.select(*(docs[f"`{c}`"] for c in kept))).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")))
    joined = rows.join(repeated(spans(rows, run)), ["doc_id", "variant"], "left").select("row", "text", "spans")
    types = dict(zip(joined.columns, joined.schema, strict=True))

    def cut(batches):
        for b in batches:
            texts, words, pieces = [], [], []
            for text, found in zip(b.column(1), b.column(2), strict=True):
                if text.is_valid and found.is_valid:
                    t, w, p = cut_words(text.as_py(), [(x["first"], x["last"]) for x in found.as_py()])
                else:
                    t, w, p = text.as_py(), 0, 0
                texts.append(t)
                words.append(w)
                pieces.append(p)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(words, pa.int64()), pa.array(pieces, pa.int64())], names=["row", "text", *new])

    schema = StructType([types["row"], StructField("text", StringType()), *(StructField(c, LongType()) for c in new)])
    out = joined.mapInArrow(cut, schema)
    return out.select(*((F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in kept), *new)

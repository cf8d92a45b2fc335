"""Packing documents into training sequences along a space-filling curve.

Each document becomes token ids and a hashed vector of them, projected to a few dimensions
and quantised; the Hilbert index of that cell orders the corpus, so neighbours in a sequence
are alike.  The tokens are range-shuffled once by (Hilbert key, doc_id), copies are thereby
spread over tasks, and each range is cut every ``length`` tokens.  What is left at the end
of a range is cut into powers of two, which need no padding, so no range waits for another.
"""

from __future__ import annotations

import functools
import math
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import arrow_schema, batch_of, materialize

LENGTH, END_ID, DIMS, BITS, FEATURES = 2048, 1, 3, 10, 64
#: entries of a worker's cache of words; it starts anew when full
CACHE_WORDS, ROWS_AT_ONCE, BYTES_AT_ONCE = 300_000, 4000, 12 << 20
SEQUENCES_A_RANGE = 1 << 40
#: a range is a task; more of them are made where shuffle partitions would hold more ids than this
IDS_A_RANGE = 1 << 25


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of texts by a tokenizer that never joins what a space or line feed parts, nor a letter or digit and a stop.

    Texts are split at spaces in Arrow, stops behind a letter or digit become chunks of their own, and each
    distinct chunk is encoded once, which gives the ids of encoding the whole text at a small part of the time.
    A chunk of Latin letters alone, whose lower case is known letter by letter, needs no normaliser: such chunks
    are encoded many at a time, and each ends with the one id that carries the end-of-word mark.  All other
    chunks go through the whole tokenizer.  Special tokens are told apart by case, so a text that may hold one
    is not lower-cased before.
    """

    WORDS_AT_ONCE, LINES_AT_ONCE = 500, 50
    LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
    STOPS, PARTED = "([0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])([.,!?])", r"\1 \2"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.coder, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for coder in (self.coder, self.plain):
            coder.no_padding()
            coder.no_truncation()
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_of = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.plain.normalizer, self.plain.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(self.coder.get_vocab_size(with_added_tokens=True), bool)
        for token, k in self.coder.get_vocab(with_added_tokens=True).items():
            self.ends[k] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts = array("I"), array("q", [0])

    def _keep(self, words: list[str], ids: np.ndarray, borders: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.starts) - 1, len(self.starts) - 1 + len(words)), strict=True))
        self.starts.frombytes((borders + len(self.flat)).astype(np.int64).tobytes())
        self.flat.frombytes(ids.astype(np.uint32).tobytes())

    def _encode(self, words: list[str]) -> None:
        letters, size = self.LETTERS.fullmatch, self.WORDS_AT_ONCE
        plain, rest = [], []
        for w in words:
            (plain if letters(w) else rest).append(w)
        for k in range(0, len(plain), size * self.LINES_AT_ONCE):
            part = plain[k : k + size * self.LINES_AT_ONCE]
            lines = [" ".join(part[i : i + size]).lower().translate(self.bytes_of) for i in range(0, len(part), size)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.plain.encode_batch_fast(lines, add_special_tokens=False)])
            self._keep(part, ids, np.flatnonzero(self.ends[ids]) + 1)
        for k in range(0, len(rest), size * self.LINES_AT_ONCE):
            part = rest[k : k + size * self.LINES_AT_ONCE]
            ids = [e.ids for e in self.coder.encode_batch_fast(part, add_special_tokens=False)]
            self._keep(part, np.array([x for own in ids for x in own], np.uint32), np.cumsum([len(x) for x in ids]))

    def _learn(self, chunks: list[str]) -> np.ndarray:
        """Place of each distinct chunk in the cache."""
        if len(self.known) + len(chunks) > CACHE_WORDS:
            self._forget()
        known = self.known
        self._encode([w for w in chunks if w not in known])
        return np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Token ids of each text; null and empty texts have none."""
        texts = pc.fill_null(texts, "")
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        lists = pc.split_pattern(pc.replace_substring(pc.replace_substring_regex(texts, self.STOPS, self.PARTED), "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        if not len(words):
            return [np.zeros(0, np.uint32)] * len(texts)
        place = self._learn(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        starts = np.frombuffer(self.starts, np.int64)
        begins, sizes = starts[place], starts[place + 1] - starts[place]
        at = words.indices.to_numpy()
        n = sizes[at]
        ends = np.cumsum(n)
        take = np.arange(ends[-1]) + np.repeat(begins[at] - ends + n, n)
        ids = np.frombuffer(self.flat, np.uint32)[take]
        del starts  # the arrays grow with the next chunks
        borders = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return [ids[a:b] for a, b in zip(borders[:-1], borders[1:], strict=True)]


@functools.cache
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@functools.cache
def _projection(dims: int) -> np.ndarray:
    return np.random.default_rng(11).choice([-1.0, 1.0], (FEATURES, dims))


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (n, dims) with ``bits`` bits a coordinate."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of each level
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    out = np.zeros_like(turn)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | (x[i] >> b & 1)
    return out


def curve_keys(docs: list[np.ndarray], dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """The Hilbert key of each document's hashed, normalised and projected token counts."""
    vectors = np.zeros((len(docs), FEATURES))
    for i, ids in enumerate(docs):
        if len(ids):
            vectors[i] = np.bincount((ids * np.uint32(0x9E3779B1)) >> np.uint32(26), minlength=FEATURES)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    points = vectors @ _projection(dims) / np.sqrt(FEATURES)  # within -1 .. 1
    cells = np.clip(np.floor((points + 1) / 2 * (1 << bits)), 0, (1 << bits) - 1)
    return hilbert_index(cells, bits)


def _parts(text: str, most: int) -> list[str]:
    """A long text cut behind spaces, where no token reaches across, about every ``most`` characters."""
    out, at = [], 0
    while len(text) - at > most:
        cut = text.find(" ", at + most)
        if cut < 0:
            break
        out.append(text[at : cut + 1])
        at = cut + 1
    return [*out, text[at:]]


def tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, curve_key, place, n, ids): ids as little-endian unsigned 32-bit integers, the end id last.

    ``place`` tells rows of equal key and id apart; ``n`` is the number of ids.
    """
    path = path or vocabulary()
    schema = arrow_schema("doc_id long,curve_key long,place long,n long,ids binary")

    def run(batches):
        from pyspark import TaskContext

        encode, place = tokenizer(path), TaskContext.get().partitionId() << 33
        for whole in batches:
            step = max(1, min(ROWS_AT_ONCE, whole.num_rows * BYTES_AT_ONCE // max(1, whole.nbytes)))
            for k in range(0, whole.num_rows, step):
                b = whole.slice(k, step)
                if b.nbytes > 2 * BYTES_AT_ONCE:  # a very long text
                    ids = [np.concatenate([x for part in _parts(t or "", BYTES_AT_ONCE) for x in encode(pa.array([part]))]) for t in b.column(1).to_pylist()]
                else:
                    ids = encode(b.column(1))
                ids = [np.append(x, np.uint32(END_ID)) for x in ids]
                yield batch_of(schema, doc_id=b.column(0), curve_key=curve_keys(ids), place=np.arange(place, place + len(ids)), n=[len(x) for x in ids], ids=[x.astype("<u4").tobytes() for x in ids])
                place += len(ids)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, curve_key bigint, place bigint, n bigint, ids binary")


def _cuts(left: int) -> list[int]:
    """Powers of two, largest first, that add up to ``left``."""
    return [1 << k for k in range(left.bit_length() - 1, -1, -1) if left >> k & 1]


def _pack(length: int):
    schema = arrow_schema("doc_id long,start long,ids binary,doc_tokens long,sequence_id long,offset long")

    def run(batches):
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() * SEQUENCES_A_RANGE
        open_pieces: list[tuple] = []  # of the sequence being filled: doc_id, start, ids, doc_tokens
        filled = 0
        done: dict[str, list] = {f.name: [] for f in schema}

        def put(piece, number, offset):
            for name, x in zip(done, (*piece, number, offset), strict=True):
                done[name].append(x)

        for b in batches:
            for doc_id, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, at = len(data) // 4, 0
                while at < n:
                    take = min(n - at, length - filled)
                    open_pieces.append((doc_id, at, data[4 * at : 4 * (at + take)], n))
                    at, filled = at + take, filled + take
                    if filled == length:
                        offset = 0
                        for piece in open_pieces:
                            put(piece, sequence, offset)
                            offset += len(piece[2]) // 4
                        open_pieces, filled, sequence = [], 0, sequence + 1
            if done["doc_id"]:
                yield batch_of(schema, **done)
                done.update({k: [] for k in done})
        sizes = _cuts(filled)
        room, offset = (sizes or [0])[0], 0
        for doc_id, start, data, n in open_pieces:
            while data:
                take = min(len(data) // 4, room)
                put((doc_id, start, data[: 4 * take], n), sequence, offset)
                start, data, room, offset = start + take, data[4 * take :], room - take, offset + take
                if not room:
                    sizes, sequence, offset = sizes[1:], sequence + 1, 0
                    room = (sizes or [0])[0]
        if done["doc_id"]:
            yield batch_of(schema, **done)

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, ranges: int | None = None) -> DataFrame:
    """One row a piece: doc_id, start, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Every id of every row lies in one piece; sequences hold ``length`` ids, but for the last few of each
    range, which hold a power of two.  A null or empty text is the end id alone; rows of equal or null
    id are packed as documents of their own, dealt over ranges even if all are alike.  Other columns are not read.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    kept = materialize(tokens(docs, path), "tokens")
    if ranges is None:
        ids = kept.agg(F.sum("n")).first()[0] or 0
        ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(ids / IDS_A_RANGE))
    order = ["curve_key", "doc_id", "place"]
    laid = kept.select(*order, "ids").repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return laid.select("doc_id", "ids").mapInArrow(_pack(length), "doc_id bigint, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")

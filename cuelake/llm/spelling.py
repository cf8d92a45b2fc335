"""Spelling variants: words one edit apart, found in a trie of letter counts.

Letters fall into groups, and a word is described by its length and then by how often each group occurs.  An edit changes that
vector by a surplus of one at most and a deficit of one at most: an insertion adds one to a group, a deletion takes one
away, a replacement does both or, inside a group, neither.  The vectors of all words, level by level, form a trie.  A word
is looked up by a depth-first search that may spend one surplus and one deficit on its way, and the words of the leaves it
reaches are verified letter by letter.

The vocabulary lies in many tasks, so the trie is cut below its first levels: each word is sent to the subtrie it belongs to,
and as a question to those subtries that its budget can reach and that follow its own in order, so each pair meets once.
How many levels are cut off is the least number for which no subtrie holds more than ``SUBTRIE`` words; the
number of subtries that a word visits depends on it, not on the data.  Should all levels not do (very many anagrams), subtries are cut
into blocks and the questions go to each block.  Inside a task the search goes down the subtrie with all questions at once,
depth first; questions arrive in slices, so memory is that of one subtrie.

Words hold code points up to U+00FF only, so one byte (Latin-1) stands for each, in the same order.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import arrow_schema, batch_of, discard, materialize

GROUPS, SUBTRIE, LEAF, SLICE, HELD = 16, 3_000, 24, 65_536, 200_000
#: letters in falling frequency in the languages written in this script; a letter's group is its place here modulo the number of groups
FREQUENT = "eainrtoslducmpghbvfyqwxkjzéèàóíäüñçêöáßú"


def group_table(groups: int = GROUPS) -> np.ndarray:
    """The group of each Latin-1 byte; bytes that are not in ``FREQUENT`` fall by their number."""
    table = np.arange(256) % groups
    for place, letter in enumerate(FREQUENT):
        table[ord(letter)] = place % groups
    return table


# --- words -------------------------------------------------------------------------------------------------------


def _runs(text: str, table: bytes) -> list[bytes]:
    """All runs of letters of a text; any other code point parts them, those beyond one byte too."""
    return text.encode("latin-1", "replace").translate(table).split()


def letter_table() -> bytes:
    """A-Z to lower case, other letters as they are, all else to a blank."""
    return bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 0xC0 else 32 for x in range(256))


def misspelt(run: bytes, start: int, every: int) -> bytes:
    """``run`` without one letter, where ``every`` divides its checksum, begun with that of what stands before it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, min_length: int = 7, min_count: int = 2, every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the runs of letters of whole texts, A-Z in lower case, of at least that length and number.

    ``every`` plants slips of the pen: where it divides the checksum of ``<id>:<run>``, the run loses the letter at that
    checksum modulo its length.  None leaves runs as they are.  Counts are added up in each task before they move, so a
    frequent word is a row a task.
    """
    schema, table = arrow_schema("word binary,n long"), letter_table()

    def run(batches):
        held: dict[bytes, int] = {}
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(_runs(text.as_py(), table)).items():
                    if every and len(word) >= min_length:
                        word = misspelt(word, start, every)
                    if len(word) >= min_length:
                        held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield batch_of(schema, word=list(held), n=list(held.values()))
                    held = {}
        if held:
            yield batch_of(schema, word=list(held), n=list(held.values()))

    found = docs.where(F.col(text_col).isNotNull()).select(id_col, text_col).mapInArrow(run, "word binary, n bigint")
    words = found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    return words.select(F.decode("word", "ISO-8859-1").alias("word"), "n")


def counts_of(words: list[bytes], table: np.ndarray, groups: int) -> np.ndarray:
    """How often each group occurs in each word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    rows = np.repeat(np.arange(len(words)), sizes)
    found = np.bincount(rows * groups + table[np.frombuffer(b"".join(words), np.uint8)], minlength=len(words) * groups)
    return found.reshape(len(words), groups).astype(np.int32)


def _sized(words: DataFrame, groups: int) -> DataFrame:
    """(word as bytes, n, counts): counts are the length and then those of the groups."""
    from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

    table = group_table(groups)

    def run(batches):
        for b in batches:
            own = b.column(0).to_pylist()
            if not own:
                continue
            counts = np.column_stack([np.fromiter(map(len, own), np.int32, len(own)), counts_of(own, table, groups)])
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * (groups + 1), pa.int32()), pa.array(counts.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), cells], names=["word", "n", "counts"])

    schema = StructType([StructField("word", BinaryType()), StructField("n", LongType()), StructField("counts", ArrayType(IntegerType()))])
    return words.select(F.encode("word", "ISO-8859-1").alias("word"), "n").mapInArrow(run, schema)


def _depth(sized: DataFrame, groups: int, subtrie: int) -> tuple[int, bool]:
    """How many groups to cut off, and whether subtries of that depth still hold too many words."""
    for depth in range(1, groups + 1):
        largest = sized.groupBy(F.slice("counts", 1, depth + 1).alias("head")).count().agg(F.max("count")).first()[0] or 0
        if largest <= subtrie:
            return depth, False
    return groups, True


# --- subtries ----------------------------------------------------------------------------------------------------


def reachable(depth: int) -> np.ndarray:
    """Changes of (length, first ``depth`` counts) from a word to the subtries it asks, in which each pair of words meets once.

    Same length: nothing, or one surplus or deficit or both, if the first change is a surplus.  One longer: one surplus or none.
    """
    out = [np.zeros(depth + 1, np.int32)]
    for i in range(depth):
        one = np.zeros(depth + 1, np.int32)
        one[i + 1] = 1
        out.append(one)
        for j in range(i + 1, depth):
            both = one.copy()
            both[j + 1] = -1
            out.append(both)
    for i in range(depth + 1):
        longer = np.zeros(depth + 1, np.int32)
        longer[0] = 1
        if i:
            longer[i] = 1
        out.append(longer)
    return np.array(out)


def _keys(heads: np.ndarray) -> np.ndarray:
    """One number for each head; heads that share one by chance only meet in vain, as words are verified."""
    key = np.full(len(heads), 0x9E3779B97F4A7C15, np.uint64)
    with np.errstate(over="ignore"):
        for column in heads.T:
            key = (key ^ column.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
    return key.astype(np.int64)


def _routed(sized: DataFrame, depth: int) -> DataFrame:
    """(key, asks, word, n): each word once as an entry (0) of its subtrie and once for each subtrie it asks, its own (1) or another (2)."""
    schema, changes = arrow_schema("key long,asks int,word binary,n long"), reachable(depth)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("counts")
            heads = lists.flatten().to_numpy().reshape(b.num_rows, -1)[:, : depth + 1]
            yield batch_of(schema, key=_keys(heads), asks=np.zeros(len(heads), np.int32), word=b.column("word"), n=b.column("n"))
            for change in changes:
                to = heads + change
                at = np.flatnonzero((to >= 0).all(axis=1) & (to[:, 1:].sum(axis=1) <= to[:, 0]))
                if len(at):
                    rows = b.take(pa.array(at))
                    yield batch_of(schema, key=_keys(to[at]), asks=np.full(len(at), 2 if change.any() else 1, np.int32), word=rows.column("word"), n=rows.column("n"))

    return sized.mapInArrow(run, "key bigint, asks int, word binary, n bigint")


def _blocked(routed: DataFrame, subtrie: int) -> DataFrame:
    """``routed`` with ``block``: subtries beyond the size are cut by the hash of the word, and questions go to every block."""
    large = routed.where("asks = 0").groupBy("key").count().where(F.col("count") > subtrie).select("key", F.ceil(F.col("count") / subtrie).cast("int").alias("blocks"))
    known = routed.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    return known.withColumn("block", F.explode(F.when(F.col("asks") > 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own))).drop("blocks")


class Subtrie:
    """The words of one subtrie, sorted by their counts; a node is a range of them."""

    def __init__(self, words: list[bytes], n: list[int], table: np.ndarray, groups: int):
        counts = counts_of(words, table, groups)
        order = np.lexsort(counts.T[::-1])
        self.words, self.n = np.array(words, object)[order], np.array(n, np.int64)[order]
        self.counts, self.groups, self.table = counts[order], groups, table
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(words))
        self.halves = _halves(self.words, self.sizes), _halves(self.words, self.sizes - 1)

    def near(self, words: list[bytes], own: bool) -> tuple[np.ndarray, np.ndarray]:
        """(places of the questions, places of the entries) that are one edit apart.

        ``own``: the questions are entries too, so of two words of the same length the smaller finds the larger.
        """
        counts = counts_of(words, self.table, self.groups)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        heads, tails = _halves(words, sizes)
        asked, found = [], []
        for size in np.unique(self.sizes):  # one, but for keys that collide
            for gap in (0, 1):
                at = np.flatnonzero(sizes == size - gap)
                if not len(at):
                    continue
                own_heads, own_tails = self.halves[gap]
                for q, w in self._search(0, len(self.words), 0, at, np.ones(len(at), np.int8), np.full(len(at), 1 - gap, np.int8), counts):
                    likely = ((heads[q][:, None] == own_heads[w]) | (tails[q][:, None] == own_tails[w])) & (self.sizes[w] == size)
                    i, j = np.nonzero(likely)
                    if len(i):
                        asked.append(q[i])
                        found.append(w.start + j)
        if not asked:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        asked, found = np.concatenate(asked), np.concatenate(found)
        good = np.fromiter((one_edit(words[q], self.words[w]) and not (own and words[q] > self.words[w] and len(words[q]) == len(self.words[w])) for q, w in zip(asked.tolist(), found.tolist(), strict=True)), bool, len(asked))
        return asked[good], found[good]

    def _search(self, first, last, level, own, surplus, deficit, counts):
        """Depth first: the questions ``own`` with what is left of their budgets, below the node first:last."""
        if level == self.groups or last - first <= LEAF:
            yield own, slice(first, last)
            return
        column = self.counts[first:last, level]
        edges = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [last - first]])
        asked = counts[own, level]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            more = column[a] - asked
            go = np.flatnonzero((more == 0) | ((more == 1) & (surplus > 0)) | ((more == -1) & (deficit > 0)))
            if len(go):
                yield from self._search(first + a, first + b, level + 1, own[go], surplus[go] - (more[go] == 1), deficit[go] - (more[go] == -1), counts)


def _halves(words, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the first half of ``sizes`` letters of each word, and for as many at its end as the other half has.

    ``sizes`` are the lengths of the shorter words of the pairs; one edit leaves one of the halves as it is.  Equal halves have
    equal numbers inside a process, which is all that they are used for.
    """
    half = (sizes // 2).tolist()
    heads = np.fromiter((hash(w[:h]) for w, h in zip(words, half, strict=True)), np.int64, len(words))
    tails = np.fromiter((hash(w[len(w) - s + h :]) for w, s, h in zip(words, sizes.tolist(), half, strict=True)), np.int64, len(words))
    return heads, tails


def one_edit(x: bytes, y: bytes) -> bool:
    """Whether ``x`` becomes ``y`` by one replaced or one inserted letter."""
    n = len(x)
    low, high = 0, n  # the common prefix is at least low and at most high long
    while low < high:
        middle = (low + high + 1) // 2
        if x[:middle] == y[:middle]:
            low = middle
        else:
            high = middle - 1
    if n == len(y):
        return low < n and x[low + 1 :] == y[low + 1 :]
    return n + 1 == len(y) and x[low:] == y[low + 1 :]


def _matched(blocked: DataFrame, groups: int) -> DataFrame:
    """(word, near, n_near): each pair of words that are one edit apart, both ways round."""
    schema, table = arrow_schema("word binary,near binary,n long"), group_table(groups)

    def answer(trie, words, n, own):
        q, w = trie.near(words, own)
        if len(q):
            asked, found = np.array(words, object)[q], trie.words[w]
            yield batch_of(schema, word=np.concatenate([asked, found]), near=np.concatenate([found, asked]), n=np.concatenate([trie.n[w], np.array(n, np.int64)[q]]))

    def run(batches):
        now, trie, words, n = (None, None, 0), None, [], []
        for b in batches:
            keys, blocks, asks = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "block", "asks"))
            own, counts = b.column("word").to_pylist(), b.column("n").to_pylist()
            turns = np.flatnonzero((keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])) + 1
            for p, q in zip([0, *turns.tolist()], [*turns.tolist(), len(keys)], strict=True):
                if p == q:
                    continue
                here = (keys[p], blocks[p], asks[p])
                if here != now or (asks[p] and len(words) >= SLICE):
                    if now[2] and trie:
                        yield from answer(trie, words, n, now[2] == 1)
                    elif now[2] == 0 and words and here[:2] == now[:2]:
                        trie = Subtrie(words, n, table, groups)
                    if here[:2] != now[:2]:
                        trie = None
                    now, words, n = here, [], []
                if asks[p] == 0 or trie:
                    words += own[p:q]
                    n += counts[p:q]
        if now[2] and trie and words:
            yield from answer(trie, words, n, now[2] == 1)

    dealt = blocked.repartition("key", "block").sortWithinPartitions("key", "block", "asks")
    return dealt.mapInArrow(run, "word binary, near binary, n bigint")


# --- forms and roots ---------------------------------------------------------------------------------------------


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every (word, form): forms are followed to the last, twice as far each round.

    Counts grow by a factor along a chain, so a chain is short and a few rounds end it.
    """
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.alias("a").join(now.select(F.col("word").alias("at"), F.col("root").alias("next")), F.col("root") == F.col("at"), "left")
        far = materialize(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = materialize(far.select("word", "root"), "roots") if not far.where("moved").isEmpty() else None
        if now is None:
            return far.select("word", "root")


def variants(words: DataFrame, factor: int = 10, groups: int = GROUPS, subtrie: int = SUBTRIE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for a table of distinct (word, n).

    Near are words that differ by exactly one inserted, deleted or replaced code point.  ``form`` is the near word of the largest
    n, ties to the smallest in code-point order, if its n is at least ``factor`` (over 1) times the word's own; else null.
    ``root`` follows forms to the last, the word itself if it has none.  Words hold letters up to U+00FF, in any number.
    An empty table gives an empty one.
    """
    if factor <= 1:
        raise ValueError("factor must exceed 1, or forms could lead in a circle")
    sized = materialize(_sized(words, groups), "vocabulary")
    depth, large = _depth(sized, groups, subtrie)
    routed = _routed(sized, depth)
    blocked = _blocked(routed, subtrie) if large else routed.withColumn("block", F.lit(0))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("near").alias("near")))
    near = _matched(blocked, groups).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = sized.select("word", "n").join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(-F.col("best.n") >= factor * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.n")).alias("n"))).alias("form"),
    )
    known = materialize(rows.select("word", "n", "n_near", "form.form", F.col("form.n").alias("form_n")), "variants")
    roots = _roots(known.where("form is not null").select("word", "form"))
    text = lambda c: F.decode(c, "ISO-8859-1")
    out = known.join(roots, "word", "left")
    return out.select(text("word").alias("word"), "n", "n_near", text("form").alias("form"), "form_n", text(F.coalesce("root", "word")).alias("root"))


def spelling_variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, factor: int = 10, every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``variants`` of the ``vocabulary`` of ``docs``.

    Null texts and texts without letters have no words; a null id counts as an empty one; repeated rows count each; other
    columns are not read.  A run of letters is a word at any length.
    """
    return variants(vocabulary(docs, min_length, min_count, every, id_col, text_col), factor)

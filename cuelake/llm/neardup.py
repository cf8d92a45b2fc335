"""Near-duplicate groups by word-shingle similarity: SimHash links first, then what its radius cannot reach.

The first links come from the SimHash operator: fingerprints of the same shingles, linked by its covering
masks, and each text compared with the first of its fingerprint and those with one another.  A pair at the similarity asked
for may differ in far more bits than masks can cover (a pair of Jaccard 0.8 in about ten of 64), so the rest
is found by an exact prefix filter.  Shingles have one order for all texts, rare ones first.  Two sets of Jaccard
similarity ``s`` or more share a shingle among the first ``n - ceil(s * n) + 1`` of each (``n``: size of the
set), so texts that meet in no bucket of such a prefix cannot be linked, whatever the order is: the order,
taken from a sample of the texts, decides only how large buckets become.

A bucket's head is the text of the smallest id in it; near copies have the same heads in most buckets.  Each text
is compared first with its heads, and then all pairs of a bucket that stand in different groups are compared: pairs
of one group would change nothing, so a large group of near copies is never listed.  Each set has a parity bitmap; two bitmaps differ in no more bits than
the sets in shingles, so pairs too far apart go without a loss.  A pair becomes a link only if the exact Jaccard
similarity of the shingle sets reaches the threshold; groups are connected components of links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import arrow_schema, as_row, batch_of, clashing_ids, discard, materialize, release
from cuelake.llm.graph import connected_components
from cuelake.llm.simhash import fingerprint_links, majority, shingle_hashes, signed

#: the order of shingles is taken from about SAMPLE texts and names at most COMMON shingles; neither changes a result
WIDTH, SIMILARITY, SAMPLE, COMMON, OFTEN, PARITY_BITS = 5, 0.8, 10_000, 50_000, 3, 9
#: sets larger than this have a second bitmap, as the first is full
MANY = 1024
#: pairs that one task verifies with the same text
PAIRS_A_PART = 2000


def shingles_of(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(words, width)]))


def common_shingles(docs: DataFrame, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the shingles that are most frequent in a sample of the texts."""
    schema = arrow_schema("shingle long,n long")
    n = docs.count()
    asked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // SAMPLE))) == 0).select("text")

    def run(batches):
        for b in batches:
            sets = [shingles_of((t or b"").lower().split(), width) for t in b.column(0).cast(pa.binary()).to_pylist()]
            if sets:
                own, times = np.unique(np.concatenate(sets), return_counts=True)
                yield batch_of(schema, shingle=own.view(np.int64), n=times)

    counts = asked.mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    rows = counts.orderBy(F.desc("n"), "shingle").limit(COMMON).collect()
    hashes, times = np.array([r.shingle for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.int64)
    order = np.argsort(hashes)
    return hashes[order], times[order]


def prefix_of(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The shingles of a set that one of a set so similar must be among, rare ones first."""
    n = len(shingles)
    hashes, times = common
    if not n:
        return shingles
    known = np.zeros(n, np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, shingles), len(hashes) - 1)
        known = np.where(hashes[at] == shingles, times[at], 0)
    return shingles[np.lexsort((shingles, known))][: n - math.ceil(similarity * n - 1e-9) + 1]


def parity(shingles: np.ndarray) -> np.ndarray:
    """Whether the number of shingles of each place of a bitmap is odd."""
    odd = np.bincount((shingles >> np.uint64(64 - PARITY_BITS)).astype(np.int64), minlength=1 << PARITY_BITS) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_parity(shingles: np.ndarray) -> np.ndarray:
    """For sets of more than ``MANY`` shingles the same with about a place a shingle, by the lower bits: a bitmap's halves together are that of half the size."""
    if len(shingles) <= MANY:
        return np.zeros(0, np.int64)
    size = 1 << len(shingles).bit_length()
    odd = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def word_prints(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, h1, h2, fp, n, bits, wide, prefix): 128-bit hash of the words in order, SimHash; number, parity bitmaps and prefix of the shingles."""
    schema = pa.schema([*arrow_schema("doc_id long,h1 long,h2 long,fp long,n long"), *(pa.field(c, pa.list_(pa.int64())) for c in ("bits", "wide", "prefix"))])
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, width))

    def run(batches):
        for b in batches:
            out = {f.name: [] for f in schema}
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                words = (text.as_py() or b"").lower().split()
                h = xxhash.xxh3_128_intdigest(b" ".join(words))
                hashes = list(shingle_hashes(words, width))
                own = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
                row = (doc_id, signed(h >> 64), signed(h & (1 << 64) - 1), signed(majority(iter(hashes))), len(own), parity(own), wide_parity(own), prefix_of(own, common.value, similarity).view(np.int64))
                for name, x in zip(out, row, strict=True):
                    out[name].append(x)
            yield batch_of(schema, **out)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, h1 bigint, h2 bigint, fp bigint, n bigint, bits array<bigint>, wide array<bigint>, prefix array<bigint>")


def _apart(x: Column, y: Column) -> Column:
    """In how many bits two parity bitmaps differ."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, d: n + d)


def _apart_wide(x: Column, y: Column) -> Column:
    """The same for wide bitmaps, a larger one folded; null if there are none or one is more than twice the other, whose sets are not compared."""

    def folded(z: Column) -> Column:
        half = F.shiftright(F.size(z), 1)
        return F.zip_with(F.slice(z, F.lit(1), half), F.slice(z, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    n, m = F.size(x), F.size(y)
    return F.when((n == 0) | (m == 0), None).when(n == m, _apart(x, y)).when(n == 2 * m, _apart(folded(x), y)).when(m == 2 * n, _apart(x, folded(y)))


def _most(n: Column, m: Column, similarity: float) -> Column:
    """In how many shingles sets of these sizes may differ."""
    return (1 - similarity) / (1 + similarity) * (n + m) + 1e-6


def _possible(x: str, y: str, similarity: float) -> Column:
    """Whether two (rep, at) of a bucket can be similar enough by size and place, if this is the first shingle they share."""
    n = lambda s: F.col(f"{s}.at").bitwiseAND(F.lit((1 << 32) - 1))
    rest = lambda s: n(s) - F.shiftright(f"{s}.at", 32)
    return F.least(rest(x), rest(y)) >= similarity / (1 + similarity) * (n(x) + n(y)) - 1e-6


def buckets(texts: DataFrame) -> DataFrame:
    """(shingle, own): the places of the prefixes of texts (rep, n, bits, prefix).

    ``own`` is (rep, at); ``at`` is the place of the shingle in the prefix, and the size of the set in the lower 32 bits.
    """
    rows = texts.select("rep", "n", F.posexplode("prefix").alias("pos", "shingle"))
    return rows.select("shingle", F.struct("rep", (F.shiftleft(F.col("pos").cast("bigint"), 32) + F.col("n")).alias("at")).alias("own"))


def crowded(rows: DataFrame) -> DataFrame:
    """(shingle, own, head) of the buckets that hold more than one text.

    Most shingles of a prefix are in one text only, so shingles alone are counted first, and only rows of shared ones go on.
    Heads are a grouped minimum joined back, so a bucket of very many texts is neither sorted nor gathered.
    """
    shared = materialize(rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle"), "shared")
    release(rows.sparkSession)
    inside = materialize(rows.join(shared, "shingle", "left_semi"), "inside")
    discard(shared)
    release(rows.sparkSession)
    met = materialize(inside.join(inside.groupBy("shingle").agg(F.min("own").alias("head")), "shingle"), "buckets")
    discard(inside)
    return met


def heads(met: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): each text and the heads b < a of the buckets they meet in."""
    pairs = met.where((F.col("own.rep") > F.col("head.rep")) & _possible("own", "head", similarity))
    return pairs.select(F.col("own.rep").alias("a"), F.col("head.rep").alias("b")).distinct()


def _room(x: str, y: str, similarity: float) -> Column:
    """Whether two (rep, at) of a bucket can be similar enough by size and place: before a shingle they share no more than the places there, behind it than what is left."""
    n = lambda s: F.col(f"{s}.at").bitwiseAND(F.lit((1 << 32) - 1))
    pos = lambda s: F.shiftright(f"{s}.at", 32)
    return F.least(pos(x), pos(y)) + F.least(n(x) - pos(x), n(y) - pos(y)) >= similarity / (1 + similarity) * (n(x) + n(y)) - 1e-6


def _enough(meetings: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the pairs that can be similar enough by all shingles (a, at_a, b, at_b) that their prefixes share.

    What two sets share beside these lies behind the last of them in both, and behind the end of one of the prefixes.
    """
    met = meetings.groupBy("a", "b").agg(F.count("*").alias("c"), *(f(f"at_{k}").alias(f"{name}_{k}") for name, f in (("first", F.min), ("last", F.max)) for k in "ab"))
    n = {k: F.col(f"first_{k}").bitwiseAND(F.lit((1 << 32) - 1)) for k in "ab"}
    left = lambda name, k: n[k] - F.shiftright(f"{name}_{k}", 32)
    behind = {k: F.ceil(similarity * n[k] - 1e-9) - 1 for k in "ab"}  # as many as ``prefix_of`` leaves
    shared = F.least(F.least(left("first", "a"), left("first", "b")), F.col("c") + F.least(left("last", "a") - 1, left("last", "b") - 1), F.col("c") + F.greatest(behind["a"], behind["b"]))
    return met.where(shared >= similarity / (1 + similarity) * (n["a"] + n["b"]) - 1e-6).select("a", "b")


def other_candidates(met: DataFrame, texts: DataFrame, groups: DataFrame, done: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of all texts of a bucket that stand in different groups and share enough of their prefixes, without those that are done.

    Long texts share some shingles with very many others, and their bitmaps are full; what they share in all tells them apart, so pairs do not
    grow with the square of the texts.  Buckets of two are pairs as they are, and were met as heads; they only count.
    """
    rows = met.select("shingle", "own", F.col("own.rep").alias("node")).join(groups, "node", "left").select("shingle", "own", F.coalesce("component", "node").alias("component"))
    ends = F.min("own.rep").alias("b"), F.min_by("own.at", "own.rep").alias("at_b"), F.max("own.rep").alias("a"), F.max_by("own.at", "own.rep").alias("at_a")
    mixed = rows.groupBy("shingle").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n"), *ends).where("least < most")
    mixed = materialize(mixed.drop("least", "most"), "mixed")
    left = rows.join(mixed.where("n > 2").select("shingle"), "shingle", "left_semi").select("shingle", "own", "component", F.col("own.rep").alias("rep")).join(texts.select("rep", "n", "bits"), "rep").drop("rep")
    right = left.select("shingle", F.col("own").alias("other"), F.col("component").alias("other_component"), F.col("n").alias("other_n"), F.col("bits").alias("other_bits"))
    near = (F.col("own.rep") > F.col("other.rep")) & (F.col("component") != F.col("other_component")) & _room("own", "other", similarity)
    near &= _apart(F.col("bits"), F.col("other_bits")) <= _most(F.col("n"), F.col("other_n"), similarity)
    meetings = left.join(right, "shingle").where(near).select(F.col("own.rep").alias("a"), F.col("own.at").alias("at_a"), F.col("other.rep").alias("b"), F.col("other.at").alias("at_b"))
    pairs = _enough(meetings.unionByName(mixed.where("n = 2").select("a", "at_a", "b", "at_b")), similarity)
    found = materialize(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
    discard(mixed)
    return found


def within(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose bitmaps leave room for that similarity."""
    x, y = (texts.select(F.col("rep").alias(k), F.struct("n", "bits", "wide").alias(f"of_{k}")) for k in "ab")
    most = _most(F.col("of_a.n"), F.col("of_b.n"), similarity)
    near = (_apart(F.col("of_a.bits"), F.col("of_b.bits")) <= most) & F.coalesce(_apart_wide(F.col("of_a.wide"), F.col("of_b.wide")) <= most, F.lit(True))
    return pairs.join(x, "a").join(y, "b").where(near).select("a", "b").distinct()


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, shingles): sorted distinct 64-bit hashes of the text's word shingles; of rows of equal id the one of the least hash counts."""
    schema = arrow_schema("doc_id long,h1 long,h2 long,shingles binary")

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                words = [(t or b"").lower().split() for t in part.column(1).cast(pa.binary()).to_pylist()]
                whole = [xxhash.xxh3_128_intdigest(b" ".join(w)) for w in words]
                yield batch_of(schema, doc_id=part.column(0), h1=[signed(h >> 64) for h in whole], h2=[signed(h & (1 << 64) - 1) for h in whole], shingles=[shingles_of(w, width).tobytes() for w in words])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, h1 bigint, h2 bigint, shingles binary")
    return rows.groupBy("doc_id").agg(F.min_by("shingles", F.struct("h1", "h2")).alias("shingles"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose shingle sets have at least that Jaccard similarity."""
    schema = arrow_schema("a long,b long")

    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for k, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):  # a pair at a time, as texts may be long
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if min(len(x), len(y)) >= similarity * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[k] = both >= similarity * (len(x) + len(y) - both)
            good = pa.array(keep)
            yield batch_of(schema, a=b.column(0).filter(good), b=b.column(1).filter(good))

    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS_A_PART).cast("int").alias("parts"))  # a text may be the head of very many
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right")).join(parts, "b").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    return dealt.join(left, "a").join(right, ["b", "part"]).select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint")


def near_duplicate_groups(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, group_id), one row for each distinct non-null id: the smallest id of its group.

    Texts equal but for case of A-Z and white space are one class from the start (null, empty and blank
    texts too), so copies are never expanded.  Rows of equal id are taken for one document (``keep_one`` tells
    their texts apart).
    """
    prints = materialize(word_prints(docs.where("doc_id is not null"), width, similarity), "words")
    classes = materialize(prints.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    own = F.struct("fp", "n", "bits", "wide", "prefix")
    texts = prints.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("rep")).agg(F.min_by(own, F.struct("h1", "h2")).alias("own"))
    texts = materialize(texts.select("rep", "own.*"), "texts")
    wide, prints = prints, materialize(prints.select("doc_id", "h1", "h2"), "names")  # prefixes are in ``texts`` alone from here on
    discard(wide)
    spark = docs.sparkSession
    release(spark)

    def links_of(pairs: DataFrame) -> DataFrame:
        pairs = materialize(within(pairs, texts, similarity), "pairs")
        wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
        sets = materialize(shingle_sets(chosen, width), "sets")
        release(spark)
        out = materialize(verified(pairs, sets, similarity), "links")
        discard(sets)
        discard(pairs)
        release(spark)
        return out

    met = crowded(buckets(texts))
    whole, texts = texts, materialize(texts.drop("prefix"), "texts")
    discard(whole)
    release(spark)
    first = materialize(simhash_pairs(texts).union(heads(met, similarity)).distinct(), "pairs")
    release(spark)
    links = links_of(first)
    groups = materialize(connected_components(links), "groups")
    rest = other_candidates(met, texts, groups, first, similarity)
    if not rest.isEmpty():
        groups = connected_components(links.unionByName(links_of(rest)))
    for x in (met, first, rest, texts):
        discard(x)
    release(spark)
    named = classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("group_id"))
    return prints.join(named, ["h1", "h2"]).groupBy("doc_id").agg(F.min("group_id").alias("group_id"))


def simhash_pairs(texts: DataFrame) -> DataFrame:
    """(a, b) of texts (rep, fp): each one and the first of its fingerprint, and the first ones of fingerprints that the covering masks link."""
    named = materialize(texts.groupBy("fp").agg(F.min("rep").alias("rep")), "named")
    own = texts.select("fp", F.col("rep").alias("a")).join(named.withColumnRenamed("rep", "b"), "fp").where("a <> b").select("a", "b")
    return own.union(fingerprint_links(named).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without those whose group holds a smaller id; rows without an id stay.

    Rows of one id and different texts are documents of their own: each goes by its own text's group, and if that holds several of
    one smallest id, one of them stays.  Rows of equal id and text stay or go together.  Other columns may have any name.
    """
    doc_id = F.col("doc_id").cast("bigint")
    clashes = clashing_ids(docs.select(doc_id.alias("doc_id"), "text"))
    if clashes is None:
        groups = near_duplicate_groups(docs, width, similarity)
        gone = materialize(groups.where("group_id < doc_id").select("doc_id"), "gone")  # its size is known when the join is planned
        return docs.join(gone, "doc_id", "left_anti")
    rows = docs.select(as_row(docs).alias("row"), doc_id.alias("doc_id"), "text").join(clashes, F.col("doc_id") == F.col("__of"), "left")
    rows = rows.withColumn("node", F.when(F.col("__of").isNotNull(), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))).drop("__of")
    groups = near_duplicate_groups(rows.select(F.col("node").alias("doc_id"), "text"), width, similarity).withColumnRenamed("doc_id", "node")
    members = materialize(rows.where("node is not null").select("node", "doc_id").distinct().join(groups, "node"), "members")
    first = members.groupBy("group_id").agg(F.min(F.struct("doc_id", "node")).alias("first"))
    gone = materialize(members.join(first, "group_id").where("node <> first.node").select("node"), "gone")
    return rows.join(gone, "node", "left_anti").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))

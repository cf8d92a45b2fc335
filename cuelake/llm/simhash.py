"""SimHash fingerprints and near-duplicate groups by covering locality-sensitive hashing.

A structured family of ``2**(radius + 1) - 1`` bit masks covers the radius: bit ``i`` gets
a non-zero vector of ``radius + 1`` bits, and mask ``v`` holds the bits whose vector has an
odd inner product with ``v``.  At most ``radius`` differing bits span less than the whole
space, so some mask avoids all of them and the two fingerprints are equal under it.

Only fingerprints that share a masked value with another one go on.  They are linked
without listing the pairs of a bucket: two values at distance two or less that share a
bucket also share a value in the middle, at distance one or less from both, and each
fingerprint names its possible middles.  Grouping by middle is a grouped minimum, linear
in the number of fingerprints however large the bucket is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import arrow_schema, batch_of, materialize
from cuelake.llm.graph import connected_components

BITS, SEED, WORDS_AT_ONCE, ROWS_IN_A_BYTE = 64, 42, 1 << 16, 255


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The masks, as unsigned integers; every set of at most ``radius`` bits misses one of them."""
    top = (1 << (radius + 1)) - 1
    vectors = [i % top + 1 for i in range(bits)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, top + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of ``width`` words (or of all, if fewer), in blocks of bounded size."""
    if words and len(words) < width:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(words) - width + 1, WORDS_AT_ONCE):
        part = words[at : at + WORDS_AT_ONCE + width - 1]
        runs = zip(*(part[k:] for k in range(width)), strict=False)
        yield np.fromiter((digest(b" ".join(x), SEED) for x in runs), np.uint64)


def majority(blocks: Iterator[np.ndarray]) -> int:
    """The unsigned value whose bits are those set in over half of all hashes; 0 for none."""
    total, n = np.zeros(BITS, np.int64), 0
    for hashes in blocks:
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        n += len(bits)
        whole = len(bits) // ROWS_IN_A_BYTE * ROWS_IN_A_BYTE
        if whole:  # a byte holds the sum of 255 bits
            total += bits[:whole].reshape(-1, ROWS_IN_A_BYTE, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp bigint): 64-bit SimHash of the A-Z-lowered text's word shingles, repeats counted.

    A null, empty or blank text has fingerprint 0.  Extra columns are not read.
    """
    schema = arrow_schema("doc_id long,fp long")

    def run(batches):
        for b in batches:
            fps = [signed(majority(shingle_hashes((t or b"").lower().split(), width))) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield batch_of(schema, doc_id=b.column(0), fp=fps)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def _middles(fp: Column, masks: list[int]) -> Column:
    """For the table number in ``t``: the value itself and each value one bit away outside the mask."""
    out = None
    for t, mask in enumerate(masks):
        free = [F.lit(signed(1 << i)) for i in range(BITS) if not mask >> i & 1]
        values = F.array(fp, *(fp.bitwiseXOR(x) for x in free))
        out = F.when(F.col("t") == t, values) if out is None else out.when(F.col("t") == t, values)
    return out


def crowded(classes: DataFrame, masks: list[int]) -> DataFrame:
    """(fp, rep, t) of the fingerprints whose masked value in table ``t`` another one shares."""
    keyed = classes.select("fp", "rep", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks))).alias("t", "bucket"))
    shared = keyed.groupBy("t", "bucket").agg(F.count("*").alias("n")).where("n > 1").select("t", "bucket")
    return keyed.join(shared, ["t", "bucket"]).select("fp", "rep", "t")


def fingerprint_links(classes: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) between class representatives whose components are those of Hamming distance <= radius.

    ``classes`` has one row (fp, rep) for each distinct fingerprint.  Radius 1 and 2 are exact.
    """
    if radius not in (1, 2):
        raise ValueError("the middle of two fingerprints serves a radius of 1 or 2")
    masks = covering_masks(radius)
    members = crowded(classes, masks).repartition("fp", "t")
    middles = members.select("rep", F.explode(_middles(F.col("fp"), masks)).alias("middle"))
    if radius == 1:  # at distance one the middle is one of the two: only real fingerprints count as middles
        middles = middles.join(classes.select(F.col("fp").alias("middle")), "middle", "left_semi")
    middles = materialize(middles.distinct(), "middles")
    least = middles.groupBy("middle").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("middle", "least")
    return middles.join(least, "middle").where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): fingerprint and smallest id reachable over links of few differing bits.

    One output row for each input row, repeated ids included.  Rows of equal fingerprint are one
    class, so copies are never expanded.  A null id is never a representative: its row gets the
    component of its fingerprint, or null if no row with an id shares it.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    named = materialize(classes.where("rep is not null"), "classes")
    groups = connected_components(fingerprint_links(named, radius))
    known = named.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(known, "fp", "left").select("doc_id", "fp", "component_id")

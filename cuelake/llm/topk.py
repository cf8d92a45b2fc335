"""Exact top-k by inner product with norm buckets.

Candidates are range-sorted by falling length and cut at every ``bucket``-th place of that order into buckets
of similar length, a row each.  A first pass over the bucket of the longest gives every query a score that
its k-th best can't fall below.  In the second pass a block of queries meets a bucket only if the product of
lengths can reach that score, which is decided on the lengths alone before any vector moves; inside, each
query's local cosine threshold chooses the pruning: a high one checks the feasible range of its largest
coordinates, a low one keeps the prefix that is long enough.  What is left is verified by full products, and
the k best of each bucket are merged.

Components are integers.  Products are exact in doubles while the lengths' product is below 2**53; beyond that
they are summed as integers without limit, and a score beyond 64 bits is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelake.llm.common import arrow_schema, batch_of, materialize
from cuelake.llm.vectors import packed, usable

BUCKET, BLOCK, FOCUS, COORDINATES = 4096, 512, 4, 0.5
#: bounds are loosened by this share, far beyond the rounding of doubles
SLACK = 1e-9
EXACT = float(1 << 53)
BROADCAST_MB, SALTS, BLOCKS_A_COPY = 64, 32, 16


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, vec, dims, norm2): floor(scale * x) of each usable vector, as bytes of 64-bit floats; other columns are not read."""
    x = F.transform(F.col(vector_col), lambda x: x.cast("double") * scale)
    whole = F.transform(x, lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))  # larger doubles are integers
    rows = df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("bigint").alias("vec_id"), whole.alias("v"))
    sized = rows.select("vec_id", "v", F.size("v").alias("dims"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).alias("norm2"))
    return packed(sized, ["vec_id", "dims", "norm2"], "v")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place``, their rank from 0 by falling length among those of their dimensions.

    Only the sizes of the sorted ranges are added up in one task, one row for each range and dimension.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["dims", F.desc("norm2"), "vec_id"]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = arrow_schema("dims int,range int,own long,vec_id long,norm2 double,vec binary")

    def run(batches):
        from pyspark import TaskContext

        number, dims, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            own = []
            for d in b.column(0).to_pylist():
                dims, n = d, n + 1 if d == dims else 0
                own.append(n)
            yield batch_of(schema, dims=b.column(0), range=np.full(len(own), number, np.int32), own=own, vec_id=b.column(1), norm2=b.column(2), vec=b.column(3))

    sorted_ = materialize(ranged.select("dims", "vec_id", "norm2", "vec").mapInArrow(run, "dims int, range int, own bigint, vec_id bigint, norm2 double, vec binary"), "sorted")
    sizes = sorted_.groupBy("dims", "range").agg(F.count("*").alias("n"))
    before = sizes.select("dims", "range", (F.sum("n").over(Window.partitionBy("dims").orderBy("range")) - F.col("n")).alias("before"))
    return sorted_.join(before, ["dims", "range"]).select("dims", (F.col("own") + F.col("before")).alias("place"), "vec_id", "norm2", "vec")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Every ``size`` rows of one length order in a row: (dims, number, longest, ids, data), ids and data in that order."""
    schema = arrow_schema("dims int,number long,longest double,ids binary,data binary")

    def run(batches):
        held: list[tuple] = []

        def close():
            ids = np.array([x[2] for x in held], np.int64)
            return batch_of(schema, dims=[held[0][0]], number=[held[0][1]], longest=[held[0][3] ** 0.5], ids=[ids.tobytes()], data=[b"".join(x[4] for x in held)])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0][:2] != row[:2]:
                    yield close()
                    held = []
                held.append(row)
        if held:
            yield close()

    dealt = _numbered(rows).withColumn("number", F.floor(F.col("place") / size)).repartition("dims", "number").sortWithinPartitions("dims", "number", "place")
    return dealt.select("dims", "number", "vec_id", "norm2", "vec").mapInArrow(run, "dims int, number bigint, longest double, ids binary, data binary")


def products(data: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products of integer rows: doubles where those are exact, else Python integers."""
    bound = np.sqrt((data * data).sum(axis=1).max(initial=0.0)) * np.sqrt((queries * queries).sum(axis=1).max(initial=0.0))
    if bound < EXACT * (1 - SLACK):
        return queries @ data.T
    if bound >= 2.0**63 * (1 - SLACK):
        raise ValueError("scores may exceed 64 bits; use a smaller scale")
    whole = np.array([[int(x) for x in row] for row in data], object)
    return np.array([[int(x) for x in row] for row in queries], object) @ whole.T


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def search(query_ids, queries, floors, ids, data, k):
    """(query number, id, score) of the k best of one bucket for each query, of those that reach its floor.

    ``data`` is sorted by falling length.
    """
    lengths = np.sqrt((data * data).sum(axis=1))
    q_lengths = np.sqrt((queries * queries).sum(axis=1))
    floors = np.where(floors > 0, floors * (1 - SLACK), floors * (1 + SLACK))
    out = []
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(q_lengths * lengths[0] > 0, floors / (q_lengths * lengths[0]), np.where(floors > 0, np.inf, -np.inf))
        need = np.where(q_lengths > 0, floors / q_lengths, np.where(floors > 0, np.inf, -np.inf))
    need = np.where(need > 0, need * (1 - SLACK), need)
    by_length = []
    unit = None
    for i in np.flatnonzero(cosine <= 1 + SLACK):
        if cosine[i] < COORDINATES:
            by_length.append(i)
            continue
        if unit is None:
            unit = data / np.maximum(lengths, 1e-300)[:, None]
        # a candidate reaches the floor only with a cosine of floor / (own lengths), at least this bucket's least
        q, t = queries[i] / q_lengths[i], min(1.0, float(cosine[i]))
        keep = lengths >= need[i]
        for f in np.argsort(-np.abs(q))[:FOCUS]:
            spread = np.sqrt(max(0.0, (1 - t * t) * (1 - q[f] * q[f])))
            low = -1.0 if q[f] < -t else q[f] * t - spread
            high = 1.0 if q[f] > t else q[f] * t + spread
            keep &= (unit[:, f] >= low - SLACK) & (unit[:, f] <= high + SLACK)
        at = np.flatnonzero(keep & (ids != query_ids[i]))
        scores = products(data[at], queries[i : i + 1])[0]
        at, scores = at[scores >= floors[i]], scores[scores >= floors[i]]
        best = _best(ids[at], scores, k)
        out.append((np.full(len(best), i), ids[at][best], scores[best].astype(np.int64)))
    if by_length:
        by_length = np.array(by_length)
        prefix = int(np.searchsorted(-lengths, -need[by_length].min(), side="right"))
        for row, i in zip(products(data[:prefix], queries[by_length]), by_length, strict=True):
            at = np.flatnonzero((row >= floors[i]) & (ids[:prefix] != query_ids[i]))
            best = at[_best(ids[at], row[at], k)]
            out.append((np.full(len(best), i), ids[best], row[best].astype(np.int64)))
    return out


def _search_blocks(wanted: DataFrame, blocks: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the wanted (dims, asked, number) from query blocks and buckets.

    Blocks, which are small, go to the tasks of the buckets that they meet.  A bucket that many meet has a copy for every
    ``BLOCKS_A_COPY`` of them, so the longest one, which all meet, is dealt too.
    """
    copies = wanted.groupBy("dims", "number").agg(F.ceil(F.count("*") / BLOCKS_A_COPY).cast("int").alias("copies"))
    nothing = F.lit(None).cast("binary")
    there = buckets.join(copies, ["dims", "number"]).select("dims", "number", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("role"), "ids", "data", nothing.alias("floors"))
    asking = wanted.join(copies, ["dims", "number"]).join(blocks, ["dims", "asked"]).select("dims", "number", F.pmod(F.xxhash64("asked"), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("role"), F.col("query_ids").alias("ids"), F.col("queries").alias("data"), "floors")
    keys = ["dims", "number", "copy"]
    dealt = there.unionByName(asking).repartition(*keys).sortWithinPartitions(*keys, "role")
    schema = arrow_schema("query_id long,vec_id long,score long")

    def run(batches):
        ids = data = None
        for b in batches:
            for role, own, values, floors in zip(*(b.column(c).to_pylist() for c in ("role", "ids", "data", "floors")), strict=True):
                own = np.frombuffer(own, np.int64)
                values = np.frombuffer(values, np.float64).reshape(len(own), -1)
                if role == 0:
                    ids, data = own, values
                    continue
                found = search(own, values, np.frombuffer(floors, np.float64), ids, data, k)
                if found:
                    at, got, scores = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield batch_of(schema, query_id=own[at], vec_id=got, score=scores)

    return dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _reaches(longest: Column, need: Column) -> Column:
    return longest * (1 + SLACK) >= need


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) from tables of ``integer_vectors``; exact, ties to the smaller vec_id.

    Every candidate row but those of the query's own id counts, repeated rows each; vectors of other
    dimensions are not compared.  A query id that is there several times is searched for each of its rows,
    and the k best of all they find are kept.  Fewer than k candidates: all of them.
    """
    buckets = materialize(_blocks(candidates, bucket), "buckets")
    asked = materialize(_blocks(queries, block).withColumnRenamed("number", "asked"), "queries")
    first = buckets.where("number = 0").select("dims", "ids", "data")
    blocks = asked.select("dims", "asked", F.col("ids").alias("query_ids"), F.col("data").alias("queries"))
    small = (first.agg(F.sum(F.octet_length("data"))).first()[0] or 0) <= BROADCAST_MB << 20  # one bucket for each number of dimensions
    floors = materialize(_floors(blocks.join(F.broadcast(first) if small else first, "dims"), k), "floors")
    sizes = buckets.select("dims", "number", "longest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    wanted = floors.select("dims", "asked", "need", F.pmod(F.col("asked"), F.lit(SALTS)).cast("int").alias("salt")).join(sizes, ["dims", "salt"]).where(_reaches(F.col("longest"), F.col("need"))).select("dims", "asked", "number")
    wanted = materialize(wanted, "wanted")
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return _search_blocks(wanted, floors.drop("need"), buckets.select("dims", "number", "ids", "data"), k).withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _floors(pairs: DataFrame, k: int) -> DataFrame:
    """Query blocks with each query's k-th best score in the bucket of the longest, and the least length they need."""
    schema = arrow_schema("dims int,asked long,query_ids binary,queries binary,floors binary,need double")

    def run(batches):
        for b in batches:
            for d, number, q_ids, q, ids, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own, at = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                queries = np.frombuffer(q, np.float64).reshape(len(own), -1)
                scores = products(np.frombuffer(data, np.float64).reshape(len(at), -1), queries).astype(np.float64)
                scores[own[:, None] == at[None, :]] = -np.inf
                floors = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(own), -np.inf)
                lengths = np.sqrt((queries * queries).sum(axis=1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(lengths > 0, floors / lengths, np.where(floors > 0, np.inf, -np.inf))
                yield batch_of(schema, dims=[d], asked=[number], query_ids=[q_ids], queries=[q], floors=[floors.tobytes()], need=[float(max(need.min() * (1 - SLACK), -1e300))])

    return pairs.select("dims", "asked", "query_ids", "queries", "ids", "data").mapInArrow(run, "dims int, asked bigint, query_ids binary, queries binary, floors binary, need double")

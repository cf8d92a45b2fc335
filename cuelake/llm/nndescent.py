"""Embedding near-duplicates by NN-descent within labels.

Vectors equal in all components are one class, so exact copies are never compared.  The neighbour
graph starts from blocks of vectors that are adjacent in sign-of-random-projection order (several
orders) and is refined by joins of neighbours with neighbours of neighbours: each vector's
neighbours in either direction meet, and pairs that beat a member's worst neighbour are kept.

Edges at the threshold form components.  A vector whose whole list lies above the threshold is
saturated: its list may not hold all its links.  A link that both ends' lists lack joins two saturated
vectors, so lists are enlarged among the components of saturated vectors, as blocks instead of single
vectors: a component's members are dealt into blocks of bounded size, each with a centre and the widest
angle to it, and NN-descent runs over the centres of all such components, their lists doubled until the
worst neighbour is too far for any of the block's members to reach.  All members of blocks that can
reach one another are compared, whatever component they stand in, and only counts leave a comparison.

Recall is then audited: the links found of a sample of vectors, saturated ones included, against those
of comparing the sample with all vectors.  While it falls short, more orders are added and all is done
anew; if it never gets there, the operator raises an error.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelake.llm.common import arrow_schema, batch_of, discard, materialize
from cuelake.llm.graph import connected_components
from cuelake.llm.vectors import matrix, packed, usable

THRESHOLD, NEIGHBOURS, ORDERS, BLOCK, ROUNDS = 0.98, 8, 6, 256, 3
SIGN_BITS, MEMBERS, COMPONENT_BLOCK, SETTLED, SALTS = 20, 256, 1024, 0.01, 16
#: the audit asks for about AUDIT vectors (four times as many, if fewer than LINKED of them have links)
AUDIT, LINKED, RECALL, MOST_ORDERS = 1024, 32, 0.99, 48
_EDGES = "a bigint, b bigint, cosine double"


def _unit(cells: list[bytes]) -> np.ndarray:
    x = matrix(cells)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # lengths stay within the range of doubles
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_size(cells: list[bytes]):
    """Places of vectors of equal length: only those are comparable."""
    sizes = np.array([len(c) for c in cells])
    return [np.flatnonzero(sizes == s) for s in np.unique(sizes)]


def _best_of(ids: np.ndarray, cosines: np.ndarray, k: int, floors: np.ndarray | None = None):
    """(a, b, cosine) of the k best others of each member, above its floor."""
    np.fill_diagonal(cosines, -2)
    k = min(k, len(ids) - 1)
    if k < 1:
        return None
    top = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    got = np.take_along_axis(cosines, top, axis=1)
    keep = got > (np.full(len(ids), -2.0) if floors is None else floors)[:, None]
    row, _ = np.nonzero(keep)
    return ids[row], ids[top[keep]], got[keep]


def _seeds(vectors: DataFrame, first: int, orders: int, k: int) -> DataFrame:
    """Directed edges from blocks along ``orders`` random orders, numbered from ``first``."""
    spread = arrow_schema("turn int,label string,code long,rep long,vec binary")

    def codes(batches):
        for b in batches:
            reps, labels, cells = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_pylist()
            for at in _by_size(cells):
                own = [cells[i] for i in at]
                x = _unit(own)
                for t in range(first, first + orders):
                    planes = np.random.default_rng([t, x.shape[1]]).standard_normal((x.shape[1], SIGN_BITS))
                    signs = (x @ planes > 0) @ (1 << np.arange(SIGN_BITS)[::-1])
                    yield batch_of(spread, turn=[t] * len(at), label=labels[at], code=signs + (len(own[0]) << SIGN_BITS), rep=reps[at], vec=own)

    edges = arrow_schema("a long,b long,cosine double")

    def blocks(batches):
        held: list[tuple] = []

        def close():
            cells = [x[4] for x in held]
            for at in _by_size(cells):
                x = _unit([cells[i] for i in at])
                found = _best_of(np.array([held[i][3] for i in at]), x @ x.T, k)
                if found:
                    yield batch_of(edges, a=found[0], b=found[1], cosine=found[2])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (held[0][:2] != row[:2] or len(held) == BLOCK):
                    yield from close()
                    held = []
                held.append(row)
        if held:
            yield from close()

    keyed = vectors.select("rep", "label", "vec").mapInArrow(codes, "turn int, label string, code bigint, rep bigint, vec binary")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, "turn", "label", "code", "rep").sortWithinPartitions("turn", "label", "code", "rep")
    return ordered.mapInArrow(blocks, _EDGES)


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    best = edges.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("place") <= k).drop("place")


def _refine(graph: DataFrame, vectors: DataFrame, k: int, turn: int) -> DataFrame:
    """Edges found where a vector's neighbours, in either direction, meet each other and the vector.

    The neighbours of a vector that very many name are dealt into parts, others in each turn.
    """
    most = max(MEMBERS, 2 * k)
    floors = graph.groupBy("a").agg(F.count("*").alias("n"), F.min("cosine").alias("least")).select(F.col("a").alias("rep"), F.when(F.col("n") >= k, F.col("least")).otherwise(-2.0).alias("floor"))
    member = vectors.select("rep", "vec").join(floors, "rep", "left").withColumnRenamed("rep", "member")
    crowds = graph.groupBy(F.col("b").alias("center")).agg(F.count("*").alias("n")).where(F.col("n") > most).select("center", F.ceil(F.col("n") / most).alias("parts"))
    both = graph.select(F.col("a").alias("center"), F.col("b").alias("member")).union(graph.select("b", "a")).distinct().join(crowds, "center", "left")
    both = both.select("center", "member", F.pmod(F.xxhash64("member", F.lit(turn)), F.coalesce("parts", F.lit(1))).alias("part"))
    schema = arrow_schema("a long,b long,cosine double")

    def meet(batches):
        held: list[tuple] = []
        out: list[tuple] = []

        def close():
            for at in _by_size([r[3] for r in held]):
                own = [held[i] for i in at]
                x = _unit([r[3] for r in own])
                floors_ = np.array([-2.0 if r[4] is None else r[4] for r in own])
                found = _best_of(np.array([r[2] for r in own]), x @ x.T, k, floors_)
                if found and len(found[0]):
                    out.append(found)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (held[0][:2] != row[:2] or len(held) == 2 * most):
                    close()
                    held = []
                held.append(row)
            if out:
                a, o, c = (np.concatenate(x) for x in zip(*out, strict=True))
                yield batch_of(schema, a=a, b=o, cosine=c)
                out = []
        if held:
            close()
        if out:
            a, o, c = (np.concatenate(x) for x in zip(*out, strict=True))
            yield batch_of(schema, a=a, b=o, cosine=c)

    joined = both.join(member, "member").select("center", "part", "member", "vec", "floor").repartition("center", "part").sortWithinPartitions("center", "part", "member")
    return joined.mapInArrow(meet, _EDGES)


def _descend(graph: DataFrame, vectors: DataFrame, k: int, rounds: int = ROUNDS) -> DataFrame:
    """Rounds of refinement until few lists change."""
    size = graph.count()
    for turn in range(rounds):
        was, graph = graph, materialize(_nearest(graph.unionByName(_refine(graph, vectors, k, turn)), k), "graph")
        moved = graph.join(was, ["a", "b"], "left_anti").count()
        discard(was)
        if moved <= SETTLED * max(1, size):
            break
    return graph


def _grown(graph: DataFrame | None, vectors: DataFrame, first: int, k: int) -> DataFrame:
    """The graph with more orders (numbered from ``first``) as seeds, refined."""
    seeds = _seeds(vectors, first, ORDERS, k)
    out = materialize(_nearest(seeds if graph is None else graph.unionByName(seeds), k), "graph")
    discard(graph)
    return _descend(out, vectors, k)


def _balls(members: DataFrame) -> DataFrame:
    """(block, label, component, rep, mult, vec): members (with the size of their component) in blocks of about COMPONENT_BLOCK.

    A component of more than one block is cut by as many leading signs of random projections as it has
    blocks to the power of two, and what is then still too large by hash.  A block is named by its least member.
    """
    schema = arrow_schema("label string,component long,size long,code long,rep long,mult long,vec binary")

    def codes(batches):
        for b in batches:
            cells = b.column(5).to_pylist()
            signs = np.zeros(len(cells), np.int64)
            for at in _by_size(cells):
                x = _unit([cells[i] for i in at])
                signs[at] = (x @ np.random.default_rng([1 << 20, x.shape[1]]).standard_normal((x.shape[1], SIGN_BITS)) > 0) @ (1 << np.arange(SIGN_BITS)[::-1])
            yield batch_of(schema, label=b.column(0), component=b.column(1), size=b.column(2), code=signs, rep=b.column(3), mult=b.column(4), vec=cells)

    keyed = members.select("label", "component", "size", "rep", "mult", "vec").mapInArrow(codes, "label string, component bigint, size bigint, code bigint, rep bigint, mult bigint, vec binary")
    bits = F.least(F.lit(SIGN_BITS), F.ceil(F.log2(F.ceil(F.col("size") / COMPONENT_BLOCK))))
    celled = materialize(keyed.withColumn("cell", F.floor(F.col("code") / F.pow(F.lit(2.0), SIGN_BITS - bits)).cast("bigint")).drop("code", "size"), "cells")
    wide = celled.groupBy("component", "cell").agg(F.ceil(F.count("*") / COMPONENT_BLOCK).alias("parts")).where("parts > 1")
    parted = celled.join(wide, ["component", "cell"], "left").withColumn("part", F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1)))).drop("parts")
    names = parted.groupBy("component", "cell", "part").agg(F.min("rep").alias("block"))
    return parted.join(names, ["component", "cell", "part"]).select("block", "label", "component", "rep", "mult", "vec")


def _centers(balls: DataFrame) -> DataFrame:
    """(rep, label, vec, radius) of each block: its mean direction and the widest angle of a member to it; rep is the block."""
    schema = arrow_schema("rep long,label string,vec binary,radius double")

    def center(t: pa.Table) -> pa.Table:
        x = _unit(t["vec"].to_pylist())
        mean = x.mean(axis=0)
        mean = mean if mean.any() else x[0]
        mean /= np.linalg.norm(mean)
        wide = float(np.arccos(np.clip((x @ mean).min(), -1, 1))) + 1e-6
        return pa.table([[t["block"][0].as_py()], [t["label"][0].as_py()], [mean.tobytes()], [wide]], schema=schema)

    return balls.groupBy("block").applyInArrow(center, "rep bigint, label string, vec binary, radius double")


def _within_reach(centers: DataFrame, threshold: float, k: int) -> DataFrame:
    """(i, j), i <= j: blocks that may hold a link, each with itself included; lists of centres are enlarged until none is saturated."""
    vectors = centers.select("rep", "label", "vec")
    graph = _grown(None, vectors, 0, k)
    widest = centers.groupBy("label").agg(F.max("radius").alias("widest"))
    reach = centers.join(widest, "label").select(F.col("rep").alias("a"), F.cos(F.least(F.lit(np.pi), F.col("radius") + F.col("widest") + float(np.arccos(threshold)))).alias("far"))
    while not graph.groupBy("a").agg(F.count("*").alias("n"), F.min("cosine").alias("least")).where(F.col("n") >= k).join(reach, "a").where("least >= far").isEmpty():
        k *= 2
        graph = _descend(graph, vectors, k)
    a, b = (centers.select(F.col("rep").alias(x), F.col("radius").alias(f"radius_{x}")) for x in "ab")
    near = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("cosine")))) <= F.col("radius_a") + F.col("radius_b") + float(np.arccos(threshold)) + 1e-6
    pairs = graph.join(a, "a").join(b, "b").where(near).select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))
    return pairs.union(centers.select("rep", "rep")).distinct()


def _compared(balls: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(rep, n, other) from comparing the members of blocks: links of each member, and one member of the other block that one of them links."""
    asked = pairs.select("i", "j", F.col("i").alias("block")).union(pairs.where("i <> j").select("i", "j", "j"))
    dealt = balls.join(asked, "block").select("i", "j", "block", "rep", "mult", "vec")
    schema = arrow_schema("rep long,n long,other long")

    def compare(t: pa.Table) -> pa.Table:
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        own, rep, mult = (t[x].to_numpy() for x in ("block", "rep", "mult"))
        cells = t["vec"].to_pylist()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if len(cells[left[0]]) != len(cells[right[0]]):
            return schema.empty_table()
        x = _unit(cells)
        near = x[left] @ x[right].T >= threshold
        if i == j:
            np.fill_diagonal(near, False)
            n = near @ mult[right]
            return pa.table([rep[left], n.astype(np.int64), np.full(len(left), i)], schema=schema)
        if not near.any():
            return schema.empty_table()
        a, b = near @ mult[right], near.T @ mult[left]
        return pa.table([np.concatenate([rep[left], rep[right]]), np.concatenate([a, b]).astype(np.int64), np.concatenate([np.full(len(left), rep[right][near.any(axis=0)][0]), np.full(len(right), rep[left][near.any(axis=1)][0])])], schema=schema)

    return dealt.groupBy("i", "j").applyInArrow(compare, "rep bigint, n bigint, other bigint").where("n > 0")


def _linked(graph: DataFrame, vectors: DataFrame, threshold: float, k: int) -> tuple[DataFrame, DataFrame]:
    """(node, component) and (rep, n): components at the threshold and the number of other vectors linked to each."""
    links = graph.where(F.col("cosine") >= threshold)
    components = materialize(connected_components(links), "components")
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    listed = both.join(vectors.select(F.col("rep").alias("b"), "mult"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("mult").alias("n"))
    full = links.groupBy("a").count().where(F.col("count") >= k).select(F.col("a").alias("node"))
    crowded = full.join(components, "node").select("component").distinct()
    if crowded.isEmpty():
        return components, materialize(listed, "counts")
    sizes = components.groupBy("component").agg(F.count("*").alias("size")).join(crowded, "component", "left_semi")
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a component may hold a third of all vectors
    members = components.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["component", "salt"])
    balls = materialize(_balls(members.select("component", "size", F.col("node").alias("rep")).join(vectors, "rep")), "balls")
    centers = materialize(_centers(balls), "centers")
    compared = materialize(_compared(balls, _within_reach(centers, threshold, k), threshold), "compared")
    counts = compared.groupBy("rep").agg(F.sum("n").alias("whole"))
    counts = listed.join(counts, "rep", "full").select("rep", F.coalesce("whole", "n").alias("n"))
    named = components.withColumnRenamed("node", "rep")
    bridges = compared.select("rep", "other").join(named, "rep").join(named.select(F.col("rep").alias("other"), F.col("component").alias("into")), "other").where("component <> into").select(F.col("component").alias("a"), F.col("into").alias("b")).distinct()
    joined = connected_components(bridges).select(F.col("node").alias("component"), F.col("component").alias("into"))
    out = components.join(joined, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    return materialize(out, "components"), materialize(counts, "counts")


def audit(counts: DataFrame, vectors: DataFrame, threshold: float = THRESHOLD, most: int = AUDIT) -> tuple[float, int, list[str]]:
    """Mean share of the true links that ``counts`` (rep, n) gives to sampled vectors that have any, their number, and the labels below ``RECALL``."""
    n = vectors.count()
    rows = vectors.where(F.pmod(F.xxhash64("rep"), F.lit(max(1, n // most))) == 0).select("rep", "label", "vec").limit(2 * most).collect()
    asked = vectors.sparkSession.sparkContext.broadcast([(r.rep, r.label, bytes(r.vec)) for r in rows])
    schema = arrow_schema("rep long,n long")

    def compare(batches):
        for b in batches:
            reps, labels, mults, cells = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_numpy(), b.column(3).to_pylist()
            groups: dict = {}
            for i, (label, c) in enumerate(zip(labels, cells, strict=True)):
                groups.setdefault((label, len(c)), []).append(i)
            for (label, size), at in groups.items():
                own = [q for q in asked.value if q[1] == label and len(q[2]) == size]
                if own:
                    ids = np.array([q[0] for q in own])
                    near = (_unit([q[2] for q in own]) @ _unit([cells[i] for i in at]).T >= threshold) & (ids[:, None] != reps[at])
                    yield batch_of(schema, rep=ids, n=(near @ mults[at]).astype(np.int64))

    true = vectors.select("rep", "label", "mult", "vec").mapInArrow(compare, "rep bigint, n bigint").groupBy("rep").agg(F.sum("n").alias("truth")).where("truth > 0")
    share = F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / F.col("truth"))
    labelled = true.join(counts, "rep", "left").join(vectors.select("rep", "label"), "rep").groupBy("label").agg(F.sum(share).alias("share"), F.count("*").alias("n"))
    found = labelled.collect()  # no more labels than sampled vectors
    asked.unpersist()
    linked = sum(r.n for r in found)
    if linked < LINKED and most == AUDIT and n > 2 * most:
        return audit(counts, vectors, threshold, 4 * most)
    return (sum(r.share for r in found) / linked if linked else 1.0), linked, [r.label for r in found if r.share < RECALL * r.n]


def _joined(near: np.ndarray) -> np.ndarray:
    """For each vertex of a symmetric graph the least one that it reaches."""
    least = np.arange(len(near))
    while True:
        new = np.minimum(least, np.where(near, least[None, :], len(near)).min(axis=1, initial=len(near)))
        if (new == least).all():
            return least
        least = new


def exact_links(vectors: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(node, component) and (rep, n) of ``vectors`` (rep, label, mult, vec) by comparing all blocks of a label, dealt over all tasks.

    Its work grows with the square of a label, so it is kept for labels on which NN-descent falls short.  A pair of blocks gives a row
    a member, with its links and one member of those it is joined to, however many links there are.
    """
    rows = vectors.select("label", F.octet_length("vec").alias("size"), "rep", "mult", "vec")
    sizes = rows.groupBy("label", "size").agg(F.ceil(F.count("*") / COMPONENT_BLOCK).cast("int").alias("parts"))
    placed = rows.join(sizes, ["label", "size"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("beside", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = placed.select("label", "size", F.least("part", "beside").alias("i"), F.greatest("part", "beside").alias("j"), "part", "rep", "mult", "vec")
    schema = arrow_schema("rep long,n long,other long")

    def compare(t: pa.Table) -> pa.Table:
        own, rep, mult = (t[x].to_numpy() for x in ("part", "rep", "mult"))
        x = _unit(t["vec"].to_pylist())
        near = x @ x.T >= threshold
        if t["i"][0].as_py() == t["j"][0].as_py():
            np.fill_diagonal(near, False)
        else:
            near &= own[:, None] != own[None, :]
        if not near.any():
            return schema.empty_table()
        return pa.table([rep, (near @ mult).astype(np.int64), rep[_joined(near)]], schema=schema)

    found = materialize(dealt.groupBy("label", "size", "i", "j").applyInArrow(compare, "rep bigint, n bigint, other bigint").where("n > 0"), "exact")
    return connected_components(found, "rep", "other"), found.groupBy("rep").agg(F.sum("n").alias("n"))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", threshold: float = THRESHOLD, k: int = NEIGHBOURS) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_recall), one row for each input row.

    Rows are compared only within a label (or all together, if ``label_col`` is None) and only with
    vectors of equal dimensions.  A row whose label or vector is null, whose vector is empty, zero or
    holds a null or non-finite component links with nothing.  Rows of equal id are vectors of their own.
    A null id has no component and is not kept.  Other columns, whatever their names, are not read.
    ``audited_recall`` is the mean share of true links found for a sample of vectors.  Labels on which it still is below ``RECALL``
    after ``MOST_ORDERS`` orders are compared in full by blocks.
    """
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), label.alias("label"), F.col(vector_col).alias("v"))
    there = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")), F.lit(False))
    good = rows.where(there).where(F.exists("v", lambda x: x != 0))
    cells = materialize(packed(good, ["vec_id", "label"], "v"), "cells")
    vectors = materialize(cells.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")), "classes")
    graph, first = None, 0
    while True:
        graph = _grown(graph, vectors.select("rep", "label", "vec"), first, k)
        components, counts = _linked(graph, vectors, threshold, k)
        recall, _, short = audit(counts, vectors, threshold)
        first += ORDERS
        if recall >= RECALL or first >= MOST_ORDERS:
            break
    discard(graph)
    links = [(vectors, components, counts)]
    if recall < RECALL:
        marked = F.broadcast(df.sparkSession.createDataFrame([(x,) for x in short], "label string"))  # of a sample of fixed size
        poor = vectors.join(marked, "label", "left_semi")
        exact_components, exact_counts = (materialize(x, "exact") for x in exact_links(poor, threshold))
        links = [(vectors.join(marked, "label", "left_anti"), components, counts), (poor, exact_components, exact_counts)]
        recall = audit(counts.join(poor, "rep", "left_anti").unionByName(exact_counts), vectors, threshold)[0]

    def known_links(own: DataFrame, components: DataFrame, counts: DataFrame) -> DataFrame:
        both = own.join(components.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left")
        return both.select("label", "vec", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"))

    known = functools.reduce(DataFrame.unionByName, (known_links(*x) for x in links))
    found = cells.join(known, ["label", "vec"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = rows.where(~there | ~F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False)))
    every = found.unionByName(alone.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")))
    return every.withColumn("audited_recall", F.lit(float(recall)))

"""Exact k-means over integer vectors, with bounds that planar geometry tightens.

Every vector carries an upper bound of the distance to its own centroid and a lower bound of that to all others.
When the centroids have moved, the upper bound grows by its own centroid's drift.  The lower bound need not shrink by
the full drift of another centroid: the vectors of a cluster lie in a sphere, and how much nearer a centroid that went
from p to q can come to any point of it is a question in the plane of p, q and the sphere's centre.  Points that came
nearer by t or more lie inside one branch of a hyperbola with foci p and q, which lies in the cone around the way from p to
q, apex in its middle, whose half angle has cosine t / |pq|.  A sphere seen from the apex at angles of at least phi is
outside all cones narrower than phi, so nothing in it came nearer by more than |pq| cos(phi), and by nothing at all from a
right angle on.  Vectors whose bounds cross are tightened against their own centroid, and those that still are ambiguous
are scanned against all centroids.  Distances are exact integers, so ties go to the smaller number without doubt.

Each pass is one map over the vectors, with centroids and drifts (numbers of clusters times dimensions) in its closure;
its rows are written to the shared folder.  Sums are added up in each task first; only a row a cluster and dimension
reaches the driver.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import arrow_schema, batch_of, discard, materialize
from cuelake.llm.vectors import matrix, packed, usable

#: bounds are loosened by this share, far beyond the rounding of doubles
SLACK = 1e-9
EXACT = float(1 << 53)
STATE = "vec_id long,vec binary,cluster int,upper double,lower double,distance long,n_scans int"
STATE_DDL = "vec_id bigint, vec binary, cluster int, upper double, lower double, distance bigint, n_scans int"


def largest_component(dims: int) -> int:
    """Components below this in size keep every squared distance within 64 bits."""
    return math.isqrt((2**63 - 1) // max(1, dims)) // 2


def integer_rows(df: DataFrame, dims: int, scale: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vec): floor(scale * x) of each usable vector of ``dims`` components, as bytes of 64-bit floats."""
    x = F.transform(F.col(vector_col), lambda x: x.cast("double") * scale)
    whole = F.transform(x, lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))  # larger doubles are integers
    rows = df.where(usable(F.col(vector_col)) & (F.size(vector_col) == dims)).select(F.col(id_col).cast("bigint").alias("vec_id"), whole.alias("v"))
    return packed(rows, ["vec_id"], "v")


def seed_key(vec_id: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), vec_id.cast("string")).cast("binary"), 256)


def loosening(centre: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> float:
    """The most by which any point within ``radius`` of ``centre`` can be nearer to ``new`` than it was to ``old``."""
    way = new - old
    drift = float(np.linalg.norm(way))
    sight = centre - (old + new) / 2
    far = float(np.linalg.norm(sight))
    if drift == 0.0:
        return 0.0
    if far <= radius * (1 + SLACK):
        return drift * (1 + SLACK)
    angle = math.acos(max(-1.0, min(1.0, float(sight @ way) / (far * drift)))) - math.asin(min(1.0, radius / far)) - SLACK
    if angle >= math.pi / 2:
        return 0.0
    return drift * math.cos(max(0.0, angle)) * (1 + SLACK)


def loosenings(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster the largest ``loosening`` of its sphere (centred where its centroid was) against the others' moves."""
    k = len(old)
    return np.array([max((loosening(old[j], radius[j], old[i], new[i]) for i in range(k) if i != j), default=0.0) for j in range(k)])


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows, exact: as doubles while those are, else as 64-bit integers."""
    reach = (np.sqrt((x * x).sum(axis=1).max(initial=0.0)) + np.sqrt((centres * centres).sum(axis=1).max(initial=0.0))) ** 2
    if reach < EXACT * (1 - SLACK):
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)).astype(np.int64)
    whole, to = x.astype(np.int64), centres.astype(np.int64)
    return np.stack([((whole - c) ** 2).sum(axis=1) for c in to], axis=1)


def own_squared(x: np.ndarray, centres: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    gap = x.astype(np.int64) - centres.astype(np.int64)[cluster]
    return (gap * gap).sum(axis=1)


def _half_gaps(centres: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to the nearest other one."""
    if len(centres) < 2:
        return np.full(len(centres), np.inf)
    d = squared(centres, centres).astype(np.float64)
    np.fill_diagonal(d, np.inf)
    return np.sqrt(d.min(axis=1)) / 2


def assign(x: np.ndarray, centres: np.ndarray, state: tuple | None, moved: tuple | None) -> tuple:
    """(cluster, upper, lower, n_scans) of integer rows after a move of the centroids.

    ``state`` is that before it, ``moved`` the drift of each centroid and the loosening of each cluster.
    """
    n = len(x)
    if state is None:
        cluster, upper, lower, scans = np.zeros(n, np.int32), np.full(n, np.inf), np.zeros(n), np.zeros(n, np.int32)
        todo = np.arange(n)
    else:
        cluster, upper, lower, scans = (np.array(s) for s in state)
        drift, loose = moved
        upper = upper + drift[cluster]
        lower = np.maximum(0.0, lower - loose[cluster])
        bound = np.maximum(lower, _half_gaps(centres)[cluster]) * (1 - SLACK)
        todo = np.flatnonzero(upper * (1 + SLACK) >= bound)
        upper[todo] = np.sqrt(own_squared(x[todo], centres, cluster[todo]).astype(np.float64)) * (1 + SLACK)
        todo = todo[upper[todo] * (1 + SLACK) >= bound[todo]]
    if len(todo):
        d = squared(x[todo], centres)
        best = d.argmin(axis=1)
        cluster[todo] = best
        near = d[np.arange(len(todo)), best].astype(np.float64)
        upper[todo] = np.sqrt(near) * (1 + SLACK)
        others = d.astype(np.float64)
        others[np.arange(len(todo)), best] = np.inf
        lower[todo] = np.sqrt(others.min(axis=1)) * (1 - SLACK)
        scans[todo] += 1
    return cluster, upper, lower, scans


def _pass(rows: DataFrame, centres: np.ndarray, moved: tuple | None, last: bool) -> DataFrame:
    """One assignment of all rows; ``rows`` are (vec_id, vec) at first, later a state."""
    schema, fresh, limit = arrow_schema(STATE), moved is None, largest_component(centres.shape[1])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("vec").to_pylist())
            if not (np.abs(x) <= limit).all():
                raise ValueError(f"components beyond {limit}: squared distances may exceed 64 bits; use a smaller scale")
            state = None if fresh else tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower", "n_scans"))
            cluster, upper, lower, scans = assign(x, centres, state, moved)
            distance = own_squared(x, centres, cluster) if last else np.zeros(len(x), np.int64)
            yield batch_of(schema, vec_id=b.column("vec_id"), vec=b.column("vec"), cluster=cluster, upper=upper, lower=lower, distance=distance, n_scans=scans)

    return materialize(rows.mapInArrow(run, STATE_DDL), "kmeans")


def _summary(state: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New centroids, componentwise floor(sum / count), and the radius of each cluster around the old ones."""
    k, dims = centres.shape
    schema_ddl = "cluster int, part int, total bigint, radius double"
    schema = arrow_schema("cluster int,part int,total long,radius double")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("vec").to_pylist()).astype(np.int64)
            cluster, upper = b.column("cluster").to_numpy(), b.column("upper").to_numpy()
            for c in np.unique(cluster):
                own = x[cluster == c]
                totals = np.append(own.sum(axis=0), len(own))
                yield batch_of(schema, cluster=[c] * (dims + 1), part=range(dims + 1), total=totals, radius=[upper[cluster == c].max()] * (dims + 1))

    found = state.mapInArrow(run, schema_ddl).groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.max("radius").alias("radius")).collect()
    new, radius = centres.copy(), np.zeros(k)
    counts = {r.cluster: int(r.total) for r in found if r.part == dims}
    for r in found:
        radius[r.cluster] = r.radius
        if r.part < dims:
            new[r.cluster, r.part] = float(int(r.total) // counts[r.cluster])
    return new, radius


def cluster(df: DataFrame, k: int = 16, dims: int = 64, rounds: int = 3, scale: float = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_scans), one row a kept vector.

    Kept are vectors of exactly ``dims`` components without null or non-finite ones; of other columns only the id is read,
    so their names don't matter.  Components become floor(scale * x); beyond ``largest_component`` they are an error.
    Centroids start as the ``k`` kept rows of the smallest sha256 of ``<seed>:<id>``, null ids last, rows of one id in order of their
    bytes; repeated rows count each.  Fewer than k kept rows give as many clusters as rows, none an empty table.  Empty clusters stay where they
    are.  ``n_scans`` counts how often a vector was compared with all centroids, of ``rounds`` + 1 assignments.
    """
    rows = integer_rows(df, dims, scale, id_col, vector_col)
    first = rows.orderBy(seed_key(F.col("vec_id"), seed).asc_nulls_last(), "vec").limit(k).select("vec").collect()
    spark = df.sparkSession
    if not first:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, n_scans int")
    centres = matrix([bytes(r.vec) for r in first]).copy()
    state = _pass(rows, centres, None, rounds == 0)
    for r in range(rounds):
        new, radius = _summary(state, centres)
        moved = np.linalg.norm(new - centres, axis=1) * (1 + SLACK), loosenings(centres, new, radius)
        was, state = state, _pass(state, new, moved, r + 1 == rounds)
        discard(was)
        centres = new
    inertia = {r.cluster: int(r.total) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digests = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centres]
    facts = [(c, inertia[c], sum(inertia.values()), digests[c]) for c in sorted(inertia)]
    about = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return state.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_scans")

"""Exact k-means against a plain loop, and the planar bound against points of the sphere."""

import hashlib

import numpy as np
import pytest

from cuelake.llm import kmeans

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, k, dims, rounds, scale, seed=1):
    kept = [(i, np.array([int(np.floor(float(np.float32(x)) * scale)) for x in v], dtype=object)) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda x: (1, "") if x[0] is None else (0, hashlib.sha256(f"{seed}:{x[0]}".encode()).hexdigest())
    ordered = sorted(kept, key=lambda x: (*key(x), x[1].astype(np.float64).tobytes()))
    centres = [v for _, v in ordered[:k]]
    nearest = lambda v: min((int(((v - c) ** 2).sum()), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centres)):
            members = [v for (_, v), c in zip(kept, own, strict=True) if c == j]
            if members:
                centres[j] = sum(members) // len(members)
    found = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i if i is not None else -1), c, d, sum(x for _, x, y in found if y == c), total, digest[c]) for i, d, c in found)


def result(df):
    return sorted(((r.vec_id if r.vec_id is not None else -1), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("n,k,spread,rounds", [(400, 16, 0.05, 3), (300, 5, 0.6, 4), (40, 16, 0.0, 3), (9, 16, 0.3, 3), (60, 1, 0.3, 2)])
def test_equals_a_plain_loop(spark, n, k, spread, rounds):
    rng = np.random.default_rng(n)
    middles = rng.normal(0, 0.4, (7, 8))
    rows = [(i, [float(x) for x in middles[rng.integers(7)] + rng.normal(0, spread, 8)], 0) for i in range(n)]
    rows += rows[:3] + [(None, rows[0][1], 1), (7, rows[1][1], 2), (901, None, 0), (902, [1.0], 0), (903, [1.0] * 7 + [None], 0), (904, [1.0] * 7 + [float("nan")], 0), (905, [1.0] * 7 + [float("inf")], 0), (906, [], 0)]
    out = kmeans.cluster(spark.createDataFrame(rows, SCHEMA), k=k, dims=8, rounds=rounds)
    assert result(out) == plain(rows, k, 8, rounds, 64)


def test_bounds_save_scans_and_far_values_stay_exact(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(0, 300_000, (16, 8))
    rows = [(i, [float(np.float32(x)) for x in middles[i % 16] + rng.normal(0, 300, 8)], 0) for i in range(600)]
    out = kmeans.cluster(spark.createDataFrame(rows, SCHEMA), k=16, dims=8).cache()
    assert result(out) == plain(rows, 16, 8, 3, 64)
    assert sum(r.n_scans for r in out.collect()) < 4 * 600 * 0.7


def test_empty_and_clashing_columns(spark):
    assert kmeans.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(i, [float(i), 1.0], i, i, i) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, cluster int, vec int, distance int")
    assert result(kmeans.cluster(df, k=2, dims=2)) == plain([(i, v, 0) for i, v, *_ in rows], 2, 2, 3, 64)
    with pytest.raises(Exception, match="smaller scale"):
        kmeans.cluster(spark.createDataFrame([(1, [1e30, 1.0], 0)], SCHEMA), k=1, dims=2).count()


def test_loosening_holds_and_is_less_than_the_drift():
    rng, tighter = np.random.default_rng(1), 0
    for _ in range(2000):
        d = int(rng.integers(2, 6))
        centre, old = rng.normal(0, 1, d), rng.normal(0, 1, d)
        new, radius = old + rng.normal(0, rng.choice([0.05, 0.5, 2]), d), float(rng.random() * 1.5)
        x = rng.normal(0, 1, (200, d))
        x = centre + x / np.linalg.norm(x, axis=1)[:, None] * radius * (rng.random((200, 1)) ** (1 / d) if rng.random() < 0.5 else 1)
        nearer = np.linalg.norm(x - old, axis=1) - np.linalg.norm(x - new, axis=1)
        bound, drift = kmeans.loosening(centre, radius, old, new), np.linalg.norm(new - old)
        assert nearer.max() <= bound + 1e-9 and bound <= drift * (1 + 1e-8)
        tighter += bound < 0.9 * drift
    assert tighter > 400

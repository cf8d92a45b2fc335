"""Links and components of embeddings where neighbour lists are full, against all pairs."""

import numpy as np
import pytest

from cuelake.llm import nndescent


def brute(x, label):
    """Numbers of links and least members of the components of rows 0, 1, ..."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    n, own = np.zeros(len(x), np.int64), np.arange(len(x))
    for k in np.unique(label):
        at = np.flatnonzero(label == k)
        near = u[at] @ u[at].T >= 0.98
        np.fill_diagonal(near, False)
        n[at] = near.sum(axis=1)
        least = at
        while True:
            new = np.minimum(least, np.where(near, least[None, :], len(x)).min(axis=1))
            if (new == least).all():
                break
            least = new
        own[at] = least
    return n, own


def around(r, base, n, width):
    return base / np.linalg.norm(base) + width * r.standard_normal((n, len(base))) / np.sqrt(len(base))


def check(spark, x, label):
    rows = [(i, v.tolist(), int(k), "x", 1) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    got = sorted(nndescent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep string, n_links int").repartition(4)).collect())
    n, own = brute(x, label)
    assert [r.vec_id for r in got] == list(range(len(x)))
    found = np.array([r.n_links for r in got])
    assert (found <= n).all()
    return found, n, np.array([r.component_id for r in got]) == own


def test_two_full_clusters_that_touch(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal(64)
    base /= np.linalg.norm(base)
    x = np.vstack([around(r, base, 30, 0.05), around(r, base + 0.08 * r.standard_normal(64) / 8, 30, 0.05), r.standard_normal((300, 64))])
    found, n, same = check(spark, x, np.zeros(len(x)))
    assert (n[:60] == 59).all() and (found == n).all() and same.all()


@pytest.mark.parametrize("block", [1024, 64])
def test_nested_groups_hubs_and_blocks(spark, monkeypatch, block):
    """Two labels of 5,000 vectors and more: groups within groups, groups of up to 400, one vector all its group is nearest to."""
    monkeypatch.setattr(nndescent, "COMPONENT_BLOCK", block)
    r = np.random.default_rng(2)
    base = r.standard_normal(64)
    parts = [around(r, around(r, base, 1, 0.1)[0], 12, 0.03) for _ in range(30)] + [r.standard_normal((9000, 64))]
    parts += [around(r, r.standard_normal(64), int(r.integers(2, 400)), float(r.uniform(0.05, 0.25))) for _ in range(12)]
    hub = r.standard_normal(64)
    parts.append(np.vstack([hub / np.linalg.norm(hub), around(r, hub, 600, 0.19)]))
    x = np.vstack(parts)
    order = r.permutation(len(x))
    found, n, same = check(spark, x[order], (np.arange(len(x)) % 2)[order])
    assert found.sum() >= 0.999 * n.sum() and same.mean() > 0.999 and n.max() > 200


def test_labels_that_fall_short_are_compared_in_full(spark, monkeypatch):
    """The audit is told that nothing was found in label 1, and gets the exact counts afterwards."""
    monkeypatch.setattr(nndescent, "COMPONENT_BLOCK", 40)
    monkeypatch.setattr(nndescent, "MOST_ORDERS", nndescent.ORDERS)
    true, calls = nndescent.audit, []

    def told(counts, vectors, threshold):
        calls.append(1)
        return (0.5, 99, ["1"]) if len(calls) == 1 else true(counts, vectors, threshold)

    monkeypatch.setattr(nndescent, "audit", told)
    r = np.random.default_rng(4)
    x = np.vstack([around(r, r.standard_normal(16), int(r.integers(2, 60)), float(r.uniform(0.05, 0.25))) for _ in range(14)])
    label = np.arange(len(x)) % 2
    found, n, same = check(spark, x, label)
    assert (found == n).all() and same.all() and len(calls) == 2
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    out = nndescent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert {y.audited_recall for y in out.collect()} == {1.0}

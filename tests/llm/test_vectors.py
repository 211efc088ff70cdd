"""Clustering and whitening of vectors against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest

from sheetweave.llm import centroids, qd, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, vector string, x int, cached int, cluster int"


def make_vectors(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "v", 2, 3, 4) for r in rows], SCHEMA).repartition(parts)


def plain_clusters(rows, count, rounds, dims, scale=64):
    """The rule of the operator, by plain search in Python integers."""
    rows = [(i, [math.floor(scale * c) for c in v]) for i, v in rows
            if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[0] or 0, r[1])
    middles = [v for _, v in sorted(rows, key=key)[:count]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m)), k) for k, m in enumerate(middles)) for _, v in rows]

    for _ in range(rounds):
        found = assign()
        for k in range(len(middles)):
            own = [v for (_, v), (_, j) in zip(rows, found) if j == k]
            if own:
                middles[k] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    total = sum(d for d, _ in found)
    return sorted(((i, k, d, sum(e for e, j in found if j == k), total,
                    hashlib.sha256(",".join(map(str, middles[k])).encode()).hexdigest())
                   for (i, _), (d, k) in zip(rows, found)), key=repr)


def clumps(seed, n, dims, spread=0.03):
    chance = random.Random(seed)
    tops = [[chance.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    return [(k, [c + chance.gauss(0, spread) for c in chance.choice(tops)]) for k in range(n)]


ODD = [(900, None), (901, []), (902, [1.0]), (903, [None] * 5), (904, [float("nan")] + [0.0] * 4),
       (905, [float("-inf")] + [0.0] * 4), (906, [0.0] * 6), (None, [0.5] * 5), (None, [-0.5] * 5), (7, [0.25] * 5)]


@pytest.mark.parametrize("rows, count", [
    (clumps(1, 200, 5) + ODD, 8), ([(k, [0.5] * 5) for k in range(30)], 4), (clumps(2, 3, 5), 8),
    ([(k, [float(k % 2), 0.0, 0.0, 0.0, 0.0]) for k in range(40)] + [(5, [0.5, 0.0, 0.0, 0.0, 0.0])], 3), (ODD[:7], 4), ([], 4)])
def test_clusters(spark, partitions, rows, count):
    found = centroids.cluster(spark, make_vectors(spark, rows), count, 3, 5)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_clusters(rows, count, 3, 5)


def test_bounds():
    """No bound exceeds its distance, and in clumped data most centroids are never measured."""
    chance = np.random.default_rng(4)
    for size in (1, 50, 1 << 24):
        x = chance.integers(-size, size + 1, (300, 9))
        pivots = centroids.Pivots(x[:12])
        search = centroids.Search(pivots, np.concatenate((x[5:15], x[20:22] // 2, x[:1])))
        low = search.bounds(np.sqrt(pivots.distances(x).astype(float)))
        for j, c in enumerate(search.centroids):
            exact = centroids.squares(x, c)
            assert all(math.floor(b) <= e for b, e in zip(low[:, j].tolist(), exact.tolist()))
    tops = chance.integers(-60, 60, (16, 64))
    x = tops[chance.integers(0, 16, 4000)] + chance.integers(-3, 4, (4000, 64))
    pivots = centroids.Pivots(tops)
    search = centroids.Search(pivots, tops + 1)
    cluster, distance = search.nearest(x, pivots.distances(x))
    assert search.measured < 1.1 * search.rows
    assert (distance == np.stack([centroids.squares(x, c) for c in tops + 1]).min(axis=0)).all()


def test_too_large(spark):
    with pytest.raises(Exception, match="2\\*\\*26"):
        centroids.cluster(spark, make_vectors(spark, [(1, [1e30] * 5)]), 2, 1, 5).collect()


@pytest.mark.parametrize("rows, count", [
    (clumps(3, 300, 5) + ODD[:7] + clumps(3, 40, 5), 16), ([(k, [0.5 * (k % 2), 0.25, 1.0, 2.0, 3.0]) for k in range(9)], 3),
    (clumps(6, 200, 5, 0.3), 2), ([(k, [100.0 * (j == k % 5) for j in range(5)]) for k in range(50)], 5)])
def test_whitening(spark, partitions, rows, count):
    """Against the eigenvectors of the covariance of the distinct vectors."""
    found = whitening.whiten(spark, make_vectors(spark, rows), count).collect()
    use = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows
           if v and len(v) == 5 and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(v) for _, v in use}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    values = np.linalg.eigvalsh(cov)[::-1]
    rank = min(count, int((values > 1e-9 * values[0]).sum()))
    assert len(found) == len(use) * rank
    assert {r["n"] for r in found} == {n} and len({r["identity_error"] for r in found}) == 1
    assert found[0]["identity_error"] < 1e-9
    for r in found:
        assert abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-9
    exact = sorted((i, sum((n * a - int(s)) ** 2 for a, s in zip(v, sums))) for i, v in use)
    assert sorted((r["vec_id"], r["deviation"]) for r in found) == sorted(exact * rank)
    # The rows of an id side by side: its projections, up to the signs, give back its covariance.
    by_id = {}
    for r in found:
        by_id.setdefault(r["vec_id"], {}).setdefault(r["component"], set()).add(r["whitened"])
    white = {v: np.array([min(by_id[i][k]) for k in sorted(by_id[i])]) for i, v in ((i, tuple(v)) for i, v in use)
             if all(len(s) == 1 for s in by_id[i].values())}
    if len(white) == n:
        w = np.array([white[tuple(v)] for v in fit])
        turned = centred.T @ w / n  # covariance of x with a component: sqrt(value) times its direction
        assert np.allclose(cov @ turned, turned * values[:rank], atol=1e-8 * values[0] ** 1.5)
        assert np.allclose((turned ** 2).sum(axis=0), values[:rank], rtol=1e-8)


def test_whitening_of_nothing(spark):
    for rows in ([], ODD[:2] + ODD[3:6], [(1, [0.5] * 5), (2, [0.5] * 5)]):
        assert whitening.whiten(spark, make_vectors(spark, rows)).collect() == []


def test_deviation_beyond_a_long():
    middle = whitening.Centre(1 << 40, [5, 7])
    x = np.array([[0, 0], [1, 0], [1 << 30, 3]])
    assert middle.deviations(x[:1]).to_pylist() == [74]
    assert middle.deviations(x).to_pylist() == [74, None, None]
    small = whitening.Centre(3, [5, 7])
    assert small.deviations(x[:2]).to_pylist() == [74, 4 + 49]


@pytest.mark.parametrize("rows", [
    np.random.default_rng(1).normal(size=(300, 24)), np.random.default_rng(2).normal(size=(90, 24)) * np.geomspace(1, 1e-7, 24),
    np.random.default_rng(3).normal(size=(7, 24)), np.ones((4, 24)), np.tile(np.eye(24), (3, 1)), np.zeros((2, 24)),
    np.tile(np.eye(24), (3, 1)) + 1e-13 * np.random.default_rng(4).normal(size=(72, 24)),
    np.diag(np.abs(np.arange(24) - 11.5)) + np.diag(np.ones(23), 1), np.diag(np.arange(24.0)) + np.diag(np.ones(23), 1)])
def test_singular_vectors(rows):
    square = np.zeros((24, 24))
    r = np.linalg.qr(rows, mode="r")
    square[:len(r)] = r
    squared, turns = qd.decompose(square, 24)
    expected = np.linalg.svd(rows, compute_uv=False)
    assert np.allclose(np.sqrt(squared[:len(expected)]), expected, rtol=1e-13, atol=1e-14 * max(expected[0], 1))
    assert np.allclose(turns.T @ turns, np.eye(24), atol=1e-11)
    product = rows.T @ rows
    assert np.allclose(product @ turns, turns * squared, atol=1e-12 * max(squared[0], 1))


def test_small_values_are_exact():
    """dqds keeps the relative accuracy of tiny values, which a covariance would lose."""
    q, e = np.array([1.0, 1e-12, 1e-24, 1e-36]), np.array([1e-6, 1e-18, 1e-30])
    values = qd.dqds(q, e)
    assert abs(np.prod(values) / np.prod(q) - 1) < 1e-14 and values[-1] < 1e-35

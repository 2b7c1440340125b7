"""Yinyang clustering against plain k-means in whole numbers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from verbena.llm.yinyang import cluster_inertia, first_bounds, group_centroids, next_bounds, yinyang

first = lambda: F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)


def plain(rows, dim, scale, k, rounds):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), key=repr), centroids


def found(spark, rows, dim, scale, k, rounds):
    df = spark.createDataFrame(rows, "id long, v array<double>, own int, best string")
    out, centroids = yinyang(df, "id", "v", dim, scale, k, rounds, first())
    return sorted((tuple(r) for r in out.collect()), key=repr), centroids.tolist(), out, centroids


def test_clusters_equal_plain_ones(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 6))
    rows = [(i, (centres[i % 9] + 0.3 * rng.normal(size=6)).tolist(), 1, "x") for i in range(700)]
    rows += [(i, [round(x) / 2 for x in r[1]], 1, "x") for i, r in zip(range(700, 900), rows, strict=False)]  # many ties
    rows += rows[:40]
    got, centroids, out, raw = found(spark, rows, 6, 8, 12, 4)
    want, means = plain([r[:2] for r in rows], 6, 8, 12, 4)
    assert got == want
    assert centroids == means
    told = cluster_inertia(out, raw).collect()
    assert {r["inertia"] for r in told} == {sum(w[2] for w in want)}
    assert all(r["cluster_inertia"] == sum(w[2] for w in want if w[1] == r["cluster"]) for r in told[:50])
    assert told[0]["centroid_sha256"] == hashlib.sha256(",".join(map(str, means[told[0]["cluster"]])).encode()).hexdigest()


def test_odd_vectors(spark):
    """Null, short and not finite ones have no row, a null key is a key, large components count as 2 ** 27, fewer vectors than k."""
    rows = [(1, [0.5, 1e30], 0, ""), (None, [0.5, -1.0], 0, None), (2, None, 0, ""), (3, [1.0], 0, ""), (4, [1.0, None], 0, ""), (5, [1.0, float("nan")], 0, ""), (6, [float("inf"), 1.0], 0, "")]
    got, centroids, _, _ = found(spark, rows, 2, 64, 5, 2)
    assert [g[0] for g in got] == [1, None]
    assert len(centroids) == 1
    got, centroids, out, raw = found(spark, rows[2:3], 2, 64, 5, 2)
    assert got == centroids == []
    assert cluster_inertia(out, raw).count() == 0


def test_bounds_leave_out_most_distances():
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (40, 16))
    v = (centres[rng.integers(0, 40, 3000)] + rng.integers(-9, 10, (3000, 16))).astype(np.int64)
    before = centres.astype(np.int64)
    after = before + rng.integers(-2, 3, before.shape)
    group = group_centroids(before, 10)
    own, best, upper, lower = first_bounds(v, before, group)
    moved, far, _, _, made = next_bounds(v, own, upper, lower, before, after, group)
    exact = ((v[:, None, :] - after[None]) ** 2).sum(2)
    assert (moved == exact.argmin(1)).all()
    assert (far == exact.min(1)).all()
    assert made < 0.2 * exact.size

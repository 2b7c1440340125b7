"""Exact k-means over whole numbers by Yinyang grouping.

Centroids are put into groups once. Each vector keeps an upper bound of the distance to its centroid and one lower bound for each group, of the
distances to the group's centroids besides its own. When centroids move, bounds follow by how far they moved: if the upper bound
is under all lower ones the vector keeps its centroid unseen; else groups are left out one by one, and what is left is
scanned exactly, in 64-bit whole numbers. Bounds have slack for rounding and groups are left out only if strictly farther, so that ties
always go to the smaller number.

Each round writes the vectors with their bounds as a table, so a lost executor costs one round. Sums are made per
cluster before they are shuffled; the driver sees k centroids of dim numbers, never vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import free_name, release, ship, written

#: Components beyond are taken as this: squared distances of 64 of them still fit 64 bits.
MOST = 2**27
#: Relative slack of bounds.
SLACK = 1e-9
#: Vectors that are worked on at a time.
ROWS = 4096


def group_centroids(centroids: np.ndarray, groups: int) -> np.ndarray:
    """The group of each centroid: a few rounds of plain k-means over the centroids themselves, from spread out ones."""
    k = len(centroids)
    seeds = [0]
    far = ((centroids - centroids[0]).astype(float) ** 2).sum(1)
    while len(seeds) < min(groups, k):
        seeds.append(int(far.argmax()))
        far = np.minimum(far, ((centroids - centroids[seeds[-1]]).astype(float) ** 2).sum(1))
    means = centroids[seeds].astype(float)
    label = np.zeros(k, int)
    for _ in range(5):
        label = ((centroids[:, None, :] - means[None]) ** 2).sum(2).argmin(1)
        means = np.array([centroids[label == g].mean(0) if (label == g).any() else means[g] for g in range(len(means))])
    return np.unique(label, return_inverse=True)[1]


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each row of v to each centroid, in whole numbers."""
    out = np.empty((len(v), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        d = v - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def first_bounds(v: np.ndarray, centroids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """own, squared distance, upper bound, lower bounds by a scan of all centroids."""
    d = squared(v, centroids)
    own = d.argmin(1)
    rows = np.arange(len(v))
    best = d[rows, own]
    rest = np.sqrt(d.astype(float))
    rest[rows, own] = np.inf
    lower = np.stack([rest[:, group == g].min(1, initial=np.inf) for g in range(group.max() + 1)], 1)
    return own, best, np.sqrt(best.astype(float)), lower


def next_bounds(v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: np.ndarray, centroids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after centroids moved from before, and how many distances were worked out."""
    moved = np.sqrt(((centroids - before).astype(float) ** 2).sum(1))
    n_groups = group.max() + 1
    upper = upper + moved[own]
    lower = lower - np.array([moved[group == g].max() for g in range(n_groups)])
    near = lambda lo, up: lo <= up + SLACK * (1 + up)
    own = own.copy()
    # the exact distance to the own centroid is asked for in the result; it tightens the bound of all
    d = v - centroids[own]
    best = np.einsum("ij,ij->i", d, d)
    made = len(v)
    upper = np.sqrt(best.astype(float))
    some = np.flatnonzero(near(lower.min(1), upper))
    if not len(some):
        return own, best, upper, lower, made
    was, was_far, start_lower = own[some].copy(), upper[some].copy(), lower[some].copy()
    scanned = np.zeros((len(some), n_groups), bool)
    second = np.full((len(some), n_groups), np.inf)  # least distance in a scanned group besides the own centroid
    for g in range(n_groups):
        r = np.flatnonzero(near(start_lower[:, g], np.sqrt(best[some].astype(float))))
        if not len(r):
            continue
        members = np.flatnonzero(group == g)
        dist = squared(v[some[r]], centroids[members])
        made += dist.size
        scanned[r, g] = True
        pick = dist.argmin(1)
        d_pick, c_pick = dist[np.arange(len(r)), pick], members[pick]
        rows = some[r]
        better = (d_pick < best[rows]) | ((d_pick == best[rows]) & (c_pick < own[rows]))
        rest = np.sqrt(dist.astype(float))
        # the one that is now the own centroid doesn't count against it
        now = np.where(better, c_pick, own[rows])
        rest[members[None, :] == now[:, None]] = np.inf
        second[r, g] = rest.min(1, initial=np.inf)
        # the former own one becomes one of the others of its group
        lost = np.flatnonzero(better)
        old = own[rows[lost]]
        far = np.sqrt(best[rows[lost]].astype(float))
        same = scanned[r[lost], group[old]]
        np.minimum.at(second, (r[lost[same]], group[old[same]]), far[same])
        np.minimum.at(start_lower, (r[lost[~same]], group[old[~same]]), far[~same])
        own[rows[lost]], best[rows[lost]] = c_pick[lost], d_pick[lost]
    upper[some] = np.sqrt(best[some].astype(float))
    lower[some] = np.where(scanned, second, start_lower)
    return own, best, upper, lower, made


def _matrix(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), width)


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(np.ascontiguousarray(m).reshape(-1), kind))


def _assigned(df: DataFrame, key: str, dim: int, before: np.ndarray | None, centroids: np.ndarray, group: np.ndarray) -> DataFrame:
    """key, v, own, best, upper, lower after one assignment; df has key and v, and the rest but in the first round."""
    fields = f"`{key}` {df.schema[key].dataType.simpleString()}, v array<int>, own int, best bigint, upper double, lower array<double>"
    schema = to_arrow_schema(StructType.fromDDL(fields))
    n_groups = int(group.max()) + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                v = _matrix(b.column("v"), "int64", dim)
                if before is None:
                    own, best, upper, lower = first_bounds(v, centroids, group)
                else:
                    held = [b.column(c).to_numpy(zero_copy_only=False) for c in ("own", "upper")]
                    own, best, upper, lower, _ = next_bounds(v, *held, _matrix(b.column("lower"), "float64", n_groups), before, centroids, group)
                yield pa.RecordBatch.from_arrays([b.column(key), b.column("v"), pa.array(own, pa.int32()), pa.array(best), pa.array(upper), _lists(lower, pa.float64())], schema=schema)

    return df.mapInArrow(work, fields)


def _moved(df: DataFrame, dim: int, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the floor of its vectors' mean; one without vectors stays."""
    sums = df.groupBy("own").agg(F.count("*").alias("n"), *(F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dim)))
    out = centroids.copy()
    for r in sums.collect():  # k rows at most
        out[r["own"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    return out


def yinyang(vectors: DataFrame, key: str, vector: str, dim: int, scale: int, k: int, rounds: int, first: Column, groups: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance) of each vector, written, and the k centroids after so many rounds of k-means.

    A component x counts as floor(scale * x), in double precision, and as MOST at most, either way. Vectors that are null, of another length than dim, or with
    a null, NaN or infinite component have no row. Centroids start as the vectors with least `first`, in its order (ties by
    the vector; null never starts one), fewer than k if there are fewer. Equal distances go to the smaller number. Repeated rows count each; a null key is a
    key; an empty table gives no rows and no centroids. Other columns may have any names. Texts play no part.
    """
    spark = vectors.sparkSession
    ship(spark)
    whole = F.coalesce((F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    number = lambda x: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x.cast("double") * scale))
    kept = vectors.where(whole).select(F.col(key), F.transform(F.col(vector), lambda x: F.floor(number(x)).cast("int")).alias("v"), first.alias(free_name(vectors, "first")))
    order = kept.columns[-1]
    starts = kept.where(F.col(order).isNotNull()).orderBy(order, "v").limit(k).select("v").collect()  # k rows
    if not starts:
        return kept.select(key, F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).limit(0), np.zeros((0, dim), np.int64)
    centroids = np.array([r["v"] for r in starts], np.int64)
    group = group_centroids(centroids, groups or max(1, -(-len(centroids) // 4)))
    before, held = None, kept.select(key, "v")
    for _ in range(rounds):
        after = written(_assigned(held, key, dim, before, centroids, group), "yinyang")
        release(held)
        held, before, centroids = after, centroids, _moved(after, dim, centroids)
    final = written(_assigned(held, key, dim, before, centroids, group).select(key, F.col("own").alias("cluster"), F.col("best").alias("distance")), "clusters")
    release(held)
    return final, centroids


def cluster_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """found with cluster_inertia, inertia and centroid_sha256 of each row's cluster. What is broadcast has a row for each centroid."""
    spark = found.sparkSession
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    rows = [(i, sums.get(i, 0), sum(sums.values()), ",".join(map(str, c.tolist()))) for i, c in enumerate(centroids)]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, c string").withColumn("centroid_sha256", F.sha2("c", 256)).drop("c")
    return found.join(F.broadcast(told), "cluster")

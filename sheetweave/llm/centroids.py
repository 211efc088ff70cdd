"""Centroid clustering of integer vectors, with Ptolemaic lower bounds from pivots.

For any four points Ptolemy's inequality holds: d(x,c) d(p,s) >= |d(x,p) d(c,s) - d(x,s) d(c,p)|. The
pivots p and s are the starting centroids and their mean, fixed for the whole run, so each vector
keeps its distances to them in the written table, and a centroid's distances to them are worked out
once a round. A round compares, vector by vector, the lower bounds that the most telling pivot pairs
of each centroid give. The centroid with the smallest bound is measured first; another one is
measured only if its bound does not exceed the best distance so far. Distances are exact
integers. Bounds are rounded down by more than the error of their arithmetic, so neither the nearest
centroid nor a tie is ever lost: assignments equal those of the plain search.

A round is one pass: tasks emit the counts and sums of their clusters, Spark adds them by cluster
and dimension, and the driver receives k x dims sums, whatever the number of vectors. Equal vectors
and hot clusters need no group of their own.

Defined results: vectors that are null, have another number of components, or hold null, NaN or
infinite components are left out. Start vectors are ordered by hash of their id, then id (nulls last),
then components; equal ones may give equal centroids, of which the smallest number wins. Fewer vectors
than centroids give fewer centroids. Rows that repeat an id are vectors of their own. Components beyond
2**26 raise an error, as squared distances would not fit a long. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sheetweave.llm.store import Store

#: Pivot pairs that bound the distance to a centroid in a round.
PAIRS = 6
#: Vectors that are compared at a time, and the largest component.
BLOCK, LARGEST = 4096, 1 << 26
#: More than the relative error of a bound's arithmetic in doubles.
ERROR = 2.0 ** -48


def kept(vectors: DataFrame, dims: int, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, vector of the rows that take part, components as doubles."""
    vector = F.col(vector_column).cast("array<double>")
    return (vectors.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector"))
            .where((F.size("vector") == dims) & ~F.exists("vector", odd)))


def odd(component: F.Column) -> F.Column:
    """Null, NaN or infinite."""
    return component.isNull() | F.isnan(component) | (F.abs(component) == float("inf"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def lists(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as an Arrow column of lists."""
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).ravel()))


def floored(values: np.ndarray, scale: int) -> np.ndarray:
    scaled = np.floor(values * float(scale))
    if len(scaled) and np.abs(scaled).max() >= LARGEST:
        raise ValueError("a component exceeds 2**26: squared distances would not fit a long")
    return scaled.astype(np.int64)


def squares(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to a point."""
    gap = x - point
    return np.einsum("ij,ij->i", gap, gap)


class Pivots:
    """Fixed points, their distances to each other, and all pairs of distinct ones."""

    def __init__(self, starts: np.ndarray):
        points = np.unique(np.concatenate((starts, [starts.sum(axis=0) // len(starts)])), axis=0)
        self.points = points
        pairs = np.array(list(itertools.combinations(range(len(points)), 2)), np.int64).reshape(-1, 2)
        self.first, self.second = pairs[:, 0], pairs[:, 1]
        gaps = points[self.first] - points[self.second]
        self.between = np.sqrt(np.einsum("ij,ij->i", gaps, gaps).astype(np.float64))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Exact squared distances of rows to all pivots."""
        return np.stack([squares(x, p) for p in self.points], 1)


class Search:
    """The nearest of some centroids, for rows with cached pivot distances."""

    def __init__(self, pivots: Pivots, centroids: np.ndarray):
        self.centroids = centroids
        near = np.sqrt(pivots.distances(centroids).astype(np.float64))
        self.measured = self.rows = 0
        # A far vector is about as far from p as from s, so its bound is its distance to them times this.
        telling = np.abs(near[:, pivots.first] - near[:, pivots.second]) / pivots.between
        best = np.argsort(-telling, axis=1, kind="stable")[:, :PAIRS]
        self.first, self.second = pivots.first[best], pivots.second[best]
        place = np.arange(len(centroids))[:, None]
        self.near_first = near[place, self.first] / pivots.between[best]
        self.near_second = near[place, self.second] / pivots.between[best]

    def bounds(self, far: np.ndarray) -> np.ndarray:
        """Lower bounds of squared distances, rounded down, for rows of pivot distances."""
        found = np.zeros((len(far), len(self.centroids)))
        for j in range(len(self.centroids)):
            for k in range(self.first.shape[1]):
                a, b = far[:, self.first[j, k]] * self.near_second[j, k], far[:, self.second[j, k]] * self.near_first[j, k]
                np.maximum(found[:, j], np.abs(a - b) - ERROR * (a + b), out=found[:, j])
        return found * found * (1 - ERROR)

    def nearest(self, x: np.ndarray, cached: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row; ties to the smaller number."""
        low = self.bounds(np.sqrt(cached.astype(np.float64)))
        cluster = low.argmin(axis=1)
        gap = x - self.centroids[cluster]
        distance = np.einsum("ij,ij->i", gap, gap)
        self.rows, self.measured = self.rows + len(x), self.measured + len(x)
        started = cluster.copy()
        for j in range(len(self.centroids)):
            # An exact distance becomes a double by an error far below ERROR.
            open_ = np.flatnonzero((low[:, j] <= distance * (1 + ERROR)) & (started != j))
            self.measured += len(open_)
            own = squares(x[open_], self.centroids[j])
            better = (own < distance[open_]) | ((own == distance[open_]) & (j < cluster[open_]))
            distance[open_[better]], cluster[open_[better]] = own[better], j
        return cluster, distance


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            yield batch.slice(start, BLOCK)


def starting(rows: DataFrame, count: int, prefix: str, scale: int) -> np.ndarray:
    """The ``count`` vectors with the smallest hashes of their ids, in that order."""
    hashed = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256)
    found = rows.orderBy(hashed.asc_nulls_last(), F.col("vec_id").asc_nulls_last(), "vector").limit(count).collect()
    return floored(np.array([r["vector"] for r in found], np.float64), scale)


def cluster(spark: SparkSession, vectors: DataFrame, count: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64,
            prefix: str = "1:", id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector."""
    store = Store(spark)
    rows = kept(vectors, dims, id_column, vector_column)
    centroids = starting(rows, count, prefix, scale)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    pivots = Pivots(centroids)

    def prepare(batches):
        for batch in blocks(batches):
            x = floored(matrix(batch.column(1), dims), scale)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(x.astype(np.int32)), lists(pivots.distances(x))],
                                             names=["vec_id", "x", "cached"])

    ready = store.save(rows.mapInArrow(prepare, "vec_id long, x array<int>, cached array<long>"))
    for _ in range(rounds):
        centroids = moved(ready, Search(pivots, centroids), dims, len(pivots.points))
    last = Search(pivots, centroids)

    def assign(batches):
        for batch in blocks(batches):
            cluster, distance = last.nearest(*sides(batch, dims, len(pivots.points)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                                             names=["vec_id", "cluster", "distance"])

    assigned = store.save(ready.mapInArrow(assign, schema))
    exact = F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")
    totals = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(exact).collect()}
    facts = [(j, total, sum(totals.values()), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest())
             for j, total in sorted(totals.items())]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select(  # one row for each centroid at most
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sides(batch: pa.RecordBatch, dims: int, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    return matrix(batch.column(1), dims).astype(np.int64), matrix(batch.column(2), pivots)


def moved(ready: DataFrame, search: Search, dims: int, width: int) -> np.ndarray:
    """The centroids after a round: floors of the exact means; empty clusters keep theirs."""
    count = len(search.centroids)

    def gather(batches):
        sums, sizes = np.zeros((count, dims), np.int64), np.zeros(count, np.int64)
        for batch in blocks(batches):
            x, cached = sides(batch, dims, width)
            cluster, _ = search.nearest(x, cached)
            for j in np.unique(cluster):
                sums[j] += x[cluster == j].sum(axis=0)
            sizes += np.bincount(cluster, minlength=count)
        there = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(sizes[there]), lists(sums[there])],
                                         names=["cluster", "size", "sums"])

    parts = ready.mapInArrow(gather, "cluster int, size long, sums array<long>")
    added = (parts.select("cluster", "size", F.posexplode("sums").alias("dim", "part"))
             .groupBy("cluster", "dim").agg(F.sum("size").alias("size"),
                                            F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect())
    after = search.centroids.copy()
    for row in added:
        after[row["cluster"], row["dim"]] = int(row["total"]) // row["size"]
    return after


def op11_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return cluster(spark, spark.read.parquet(f"{folder}/embeddings.parquet"))


def oracle(rounds: int) -> str:
    """The plain search in SQL."""
    sql = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT) AS x
      FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64),
s AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), vec_id, x) - 1 AS k, x FROM v WHERE vec_id IS NOT NULL),
c0 AS (SELECT k, x FROM s WHERE k < 16)"""
    for n in range(rounds + 1):
        sql += f""",
a{n} AS (SELECT r, min(struct_pack(d := list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT,
                                k := k)) AS best FROM v, c{n} c GROUP BY r)"""
        if n < rounds:
            sql += f""",
m{n} AS (SELECT k, list((total - ((total % n) + n) % n) // n ORDER BY i) AS x
      FROM (SELECT best.k AS k, i, sum(x[i]) AS total, count(*) AS n FROM a{n} JOIN v USING (r), range(1, 65) t(i) GROUP BY ALL) GROUP BY k),
c{n + 1} AS (SELECT k, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m USING (k))"""
    return sql + f"""
SELECT vec_id, k::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia,
       sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM (SELECT r, best, best.k AS k FROM a{rounds}) JOIN v USING (r) JOIN c{rounds} c USING (k)"""


ORACLE = oracle(3)

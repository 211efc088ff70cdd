"""Embedding whitening by a bidiagonal qd solver.

Components become integers, and each distinct vector counts once in the fit. Tasks reduce their centred
rows block by block to the triangle R of a QR decomposition, and triangles are combined sixteen at a
time in further tasks until sixteen or fewer are left; these come to the driver, a bounded number
of dims x dims values. There R becomes bidiagonal by Householder reflections, dqds gives the singular
values and twisted factorisations the directions (qd.py). Rows are centred before anything is
multiplied: the whole part of the mean is taken off as an integer, its fraction after that.

Defined results: vectors that are null, or hold null, NaN or infinite components, are left out, and so
are those that have another number of components than most (of equally many, the larger number), as no covariance can hold
them. Components (numbered from 1) exist as far as there is variance: directions whose singular value is
rounding error of the largest have none, so a single distinct vector gives no rows. Rows that repeat an
id give rows of their own. ``deviation`` is null where its exact value does not fit a long. Components
beyond 2**45 raise an error. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from sheetweave.llm.centroids import blocks, lists, matrix, odd
from sheetweave.llm.qd import EPSILON, decompose
from sheetweave.llm.store import Store

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Largest whole component, and triangles that one task combines.
LARGEST, FAN = 1 << 45, 16
SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


def whole(vectors: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    """vec_id and x, the integers of a vector, for the rows that take part; and their number of components."""
    vector = F.col(vector_column).cast("array<double>")
    rows = (vectors.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector"))
            .where(F.col("vector").isNotNull() & ~F.exists("vector", odd)))
    most = (rows.groupBy(F.size("vector").alias("dims")).count().where("dims > 0")
            .orderBy(F.desc("count"), F.desc("dims")).first())
    dims = most["dims"] if most else 0

    def run(batches):
        for batch in blocks(batches):
            x = np.floor(matrix(batch.column(1), dims) * float(SCALE)) + OFFSET
            if len(x) and np.abs(x).max() >= LARGEST:
                raise ValueError("a component exceeds 2**45")
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(x.astype(np.int64))], names=["vec_id", "x"])

    return rows.where(F.size("vector") == dims).mapInArrow(run, "vec_id long, x array<long>"), dims


class Centre:
    """The exact mean of the fit list: sums over ``n``."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.floors = np.array([s // n for s in sums], np.int64)
        self.rests = np.array([s % n for s in sums], object)
        self.fractions = np.array([s % n / n for s in sums])

    def off(self, x: np.ndarray) -> np.ndarray:
        """Rows without the mean; the whole parts cancel exactly."""
        return (x - self.floors).astype(np.float64) - self.fractions

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum of (n x - sums)**2 of each row, exactly; null beyond a long."""
        gap = x - self.floors
        if x.shape[1] * (self.n * (int(np.abs(gap).max(initial=0)) + 1)) ** 2 < 1 << 63:
            away = self.n * gap - self.rests.astype(np.int64)
            return pa.array(np.einsum("ij,ij->i", away, away))
        totals = ((self.n * gap.astype(object) - self.rests) ** 2).sum(axis=1)
        return pa.array([t if t < 1 << 63 else None for t in totals.tolist()], pa.int64())


def added(parts: DataFrame, column: str, kind: str) -> list:
    """Sums, place by place, of the lists that tasks emit: a bounded number of values."""
    total = F.sum(F.col("value").cast(kind)).alias("value")
    rows = (parts.select(F.posexplode(column).alias("place", "value")).groupBy("place").agg(total).collect())
    return [r["value"] for r in sorted(rows, key=lambda r: r["place"])]


def centre(fit: DataFrame, dims: int) -> Centre | None:
    def run(batches):
        n, sums = 0, np.zeros(dims, object)
        for batch in blocks(batches):
            n, sums = n + batch.num_rows, sums + matrix(batch.column(0), dims).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array([[str(v) for v in (n, *sums)]])], names=["sums"])

    found = added(fit.mapInArrow(run, "sums array<string>"), "sums", "decimal(38,0)")
    return Centre(int(found[0]), [int(v) for v in found[1:]]) if found and found[0] else None


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def reduced(store: Store, fit: DataFrame, middle: Centre, dims: int) -> np.ndarray:
    """The triangle R of all centred rows, dims x dims."""
    def first(batches):
        held = np.zeros((0, dims))
        for batch in blocks(batches):
            held = triangle(np.concatenate((held, middle.off(matrix(batch.column(0), dims)))))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([held.tobytes()])],
                                         names=["part", "r"])

    def combine(group: pd.DataFrame) -> pd.DataFrame:
        held = triangle(np.concatenate([np.frombuffer(r).reshape(-1, dims) for r in group["r"]]))
        return pd.DataFrame({"part": [int(group["part"].iloc[0]) // FAN], "r": [held.tobytes()]})

    parts = store.save(fit.mapInArrow(first, "part long, r binary"))
    while parts.count() > FAN:
        parts = store.save(parts.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(combine, "part long, r binary"))
    left = [np.frombuffer(r["r"]).reshape(-1, dims) for r in parts.orderBy("part").collect()]
    found = triangle(np.concatenate(left))
    square = np.zeros((dims, dims))
    square[:len(found)] = found
    return square


def whiten(spark: SparkSession, vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id",
           vector_column: str = "embedding") -> DataFrame:
    """A row for each vector and component, see ``SCHEMA``."""
    store = Store(spark)
    rows, dims = whole(vectors, id_column, vector_column)
    fit = store.save(rows.select("x").distinct()) if dims else None
    middle = centre(fit, dims) if dims else None
    if middle is None:
        return spark.createDataFrame([], SCHEMA)
    squared, turns = decompose(reduced(store, fit, middle, dims), min(components, dims))
    there = int((squared[:turns.shape[1]] > squared[0] * (dims * EPSILON) ** 2).sum())
    if not there:
        return spark.createDataFrame([], SCHEMA)
    n, to = middle.n, turns[:, :there] / np.sqrt(squared[:there] / middle.n)
    explained = squared[:there] / squared.sum()

    def gram(batches):
        total = np.zeros(there + there * there)
        for batch in blocks(batches):
            white = middle.off(matrix(batch.column(0), dims)) @ to
            total += np.concatenate((white.sum(axis=0), (white.T @ white).ravel()))
        yield pa.RecordBatch.from_arrays([lists(total[None])], names=["sums"])

    sums = np.array(added(fit.mapInArrow(gram, "sums array<double>"), "sums", "double")) / n
    mean, products = sums[:there], sums[there:].reshape(there, there)
    error = float(np.abs(products - np.outer(mean, mean) - np.eye(there)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            x, size = matrix(batch.column(1), dims), batch.num_rows
            each = pa.array(np.repeat(np.arange(size), there))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(each), pa.array(np.tile(np.arange(1, there + 1, dtype=np.int32), size)),
                 pa.array(np.full(size * there, n)), middle.deviations(x).take(each),
                 pa.array((middle.off(x) @ to).ravel()), pa.array(np.tile(explained, size)),
                 pa.array(np.full(size * there, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, SCHEMA)


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(spark, spark.read.parquet(f"{folder}/embeddings.parquet"))

"""Clusters of symbol embeddings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sheetweave.operators.components import connected_components
from sheetweave.operators.ordering import with_position
from sheetweave.scratch import Scratch

#: Rows by hash among which the first centres of a model are drawn.
SAMPLE = 4096

# Per sensitivity the most clusters tried, and the shares of density clusters.
MAX_CLUSTERS = {"low": 20, "medium": 30, "high": 50, "very_high": 80}
SIZE_DIVISOR = {"low": 20, "medium": 50, "high": 100, "very_high": 150}
SAMPLE_RATIO = {"low": 0.7, "medium": 0.5, "high": 0.3, "very_high": 0.2}


def norm(embedding: Column) -> Column:
    squares = F.transform(embedding, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def normalised(embedding: Column) -> Column:
    length = norm(embedding) + 1e-8
    return F.transform(embedding, lambda x: x.cast("double") / length)


def _vectors(rows: DataFrame, embedding: str) -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col(embedding).cast("array<double>")))


class Models:
    """Centres of many k-means models, side by side in one matrix."""

    def __init__(self, centres: list[np.ndarray]):
        self.sizes = [len(c) for c in centres]
        self.starts = np.cumsum([0, *self.sizes[:-1]])
        self.centres = np.concatenate(centres)

    def of(self, model: int) -> np.ndarray:
        return self.centres[self.starts[model]:self.starts[model] + self.sizes[model]]

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of rows to all centres of all models: one product of matrices."""
        square = (x * x).sum(axis=1)[:, None] + (self.centres * self.centres).sum(axis=1) - 2 * x @ self.centres.T
        return np.maximum(square, 0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row and model the number of the nearest centre in the matrix and its distance."""
        far = self.distances(x)
        found = np.stack([far[:, a:a + n].argmin(axis=1) + a for a, n in zip(self.starts, self.sizes)], 1)
        return found, np.take_along_axis(far, found, axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _starting(rows: DataFrame, embedding: str, runs: list[tuple[int, int]]) -> list[np.ndarray]:
    """Centres spread over a sample of ``SAMPLE`` rows: each is drawn by its squared distance to those before."""
    drawn = rows.select(F.col(embedding).cast("array<double>").alias("e")).withColumn("h", F.xxhash64("e")).orderBy("h", "e").limit(SAMPLE)
    sample = np.unique(np.array([r["e"] for r in drawn.select("e").collect()]), axis=0)
    centres = []
    for k, seed in runs:
        chance = np.random.default_rng(seed)
        chosen = [sample[chance.integers(len(sample))]]
        far = ((sample - chosen[0]) ** 2).sum(axis=1)
        while len(chosen) < min(k, len(sample)):
            chosen.append(sample[chance.choice(len(sample), p=far / far.sum())])
            far = np.minimum(far, ((sample - chosen[-1]) ** 2).sum(axis=1))
        centres.append(np.array(chosen))
    return centres


def fit_many(rows: DataFrame, embedding: str, runs: list[tuple[int, int]], passes: int = 20,
             tolerance: float = 1e-4) -> tuple[Models, list[float]]:
    """Models for all (k, seed) and their costs. An iteration is one pass over the rows for all of them.

    A task emits sums of its rows for every centre; sums are added sixteen at a time in tasks, so the driver
    gets a bounded number of them, each as large as all the centres.
    """
    scratch = Scratch(rows.sparkSession)
    vectors = scratch.save(rows.select(F.col(embedding).cast("array<double>").alias("e")).where("e IS NOT NULL"))
    models = Models(_starting(vectors, "e", runs))
    width = models.centres.shape[1]

    def gather(batches):
        sums, sizes, cost = np.zeros_like(models.centres), np.zeros(len(models.centres)), np.zeros(len(runs))
        for batch in batches:
            x = _matrix(batch.column(0))
            found, far = models.nearest(x)
            cost += far.sum(axis=0)
            for own in found.T:
                order = np.argsort(own, kind="stable")
                there, at = np.unique(own[order], return_index=True)
                sums[there] += np.add.reduceat(x[order], at, axis=0)
                sizes[there] += np.diff(np.append(at, len(x)))
        flat = np.concatenate((sums.ravel(), sizes, cost))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([flat.tobytes()])], names=["part", "sums"])

    def add(group):
        flat = sum(np.frombuffer(b) for b in group["sums"])
        return pd.DataFrame({"part": [int(group["part"].iloc[0]) // 16], "sums": [flat.tobytes()]})

    kind = "part bigint, sums binary"
    for _ in range(passes):
        parts = scratch.save(vectors.mapInArrow(gather, kind))
        while parts.count() > 16:
            parts = scratch.save(parts.groupBy(F.floor(F.col("part") / 16)).applyInPandas(add, kind))
        flat = sum(np.frombuffer(r["sums"]) for r in parts.orderBy("part").collect())
        count = len(models.centres)
        sums, sizes, costs = flat[:count * width].reshape(count, width), flat[count * width:count * (width + 1)], flat[count * (width + 1):]
        after = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], models.centres)
        moved = float(((after - models.centres) ** 2).sum(axis=1).max())
        if moved <= tolerance ** 2:
            break
        models.centres = after
    return models, costs.tolist()


def kmeans(rows: DataFrame, embedding: str, k: int, restarts: int = 10, seed: int = 42) -> DataFrame:
    """Adds cluster_id from the best of several starts; rows without a vector have none."""
    models, costs = fit_many(rows, embedding, [(k, seed + i) for i in range(restarts)])
    best = Models([models.of(int(np.argmin(costs)))])
    names = rows.columns
    place = names.index(embedding)

    def assign(batches):
        for batch in batches:
            column = batch.column(place).cast(pa.list_(pa.float64()))
            own = np.full(batch.num_rows, -1)
            there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            if len(there):
                own[there] = best.nearest(_matrix(column.take(pa.array(there))))[0][:, 0]
            ids = pa.array(own, mask=own < 0).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*names, "cluster_id"])

    return rows.mapInArrow(assign, StructType([*rows.schema, StructField("cluster_id", IntegerType())]))


def inertias(rows: DataFrame, embedding: str, ks: range, restarts: int = 3, seed: int = 42) -> DataFrame:
    """(k, inertia) for every number of clusters tried, the best of several starts."""
    runs = [(k, seed + start) for k in ks for start in range(restarts)]
    _, costs = fit_many(rows, embedding, runs)
    best = [(k, min(c for (n, _), c in zip(runs, costs) if n == k)) for k in ks]
    return rows.sparkSession.createDataFrame(best, "k bigint, inertia double")


def cluster(rows: DataFrame, embedding: str, sensitivity: str = "medium", k: int | None = None) -> DataFrame:
    """Adds cluster_id: the number of clusters is that at the elbow, up to a limit by sensitivity, unless given."""
    if k is None:
        ks = range(2, largest_k(rows.count(), sensitivity) + 1)
        k = elbow(inertias(rows, embedding, ks)).first()["k"]
    return kmeans(rows, embedding, k)


def largest_k(rows: int, sensitivity: str = "medium") -> int:
    return max(2, min(MAX_CLUSTERS[sensitivity], rows // 3))


def elbow(costs: DataFrame) -> DataFrame:
    """One row with the number of clusters at the elbow.

    The largest second difference, and two further; with fewer than three costs
    the largest number tried. Costs are one row per number of clusters.
    """
    order = Window.partitionBy().orderBy("k")
    bend = F.lead("inertia", 2).over(order) - 2 * F.lead("inertia", 1).over(order) + F.col("inertia")
    bends = costs.withColumn("bend", bend)
    return bends.agg(F.when(F.count("k") >= 3, F.max_by("k", F.struct("bend", -F.col("k"))) + 2)
                     .otherwise(F.max("k")).alias("k"))


def pca2d(rows: DataFrame, embedding: str) -> DataFrame:
    """Adds px and py, the first two principal components."""
    vectors = _vectors(rows, embedding)
    model = PCA(k=2, inputCol="features", outputCol="flat").fit(vectors)
    return (model.transform(vectors).withColumn("flat", vector_to_array("flat"))
            .withColumns({"px": F.col("flat")[0], "py": F.col("flat")[1]}).drop("features", "flat"))


def density_parameters(rows: int, sensitivity: str = "medium") -> tuple[int, int]:
    """Smallest size of a cluster, and neighbours that make a point dense."""
    size = max(2, rows // SIZE_DIVISOR[sensitivity])
    return size, max(1, int(size * SAMPLE_RATIO[sensitivity]))


def density_clusters(points: DataFrame, row_id: str, eps: float, min_samples: int, min_size: int,
                     steps: int = 4) -> DataFrame:
    """Adds cluster_id to (row_id, px, py): dense neighbourhoods that touch, -1 for noise.

    Points are counted on a lattice of pitch eps / steps, and distances are those
    between lattice positions. So a crowd of points is one weighted position with
    a fixed number of neighbours, whatever its size.
    """
    pitch = eps / steps
    placed = points.withColumns({"gx": F.floor(F.col("px") / pitch), "gy": F.floor(F.col("py") / pitch)})
    weights = placed.groupBy("gx", "gy").agg(F.count("*").alias("weight"), F.min(row_id).alias("node"))
    around = [(dx, dy) for dx in range(-steps, steps + 1) for dy in range(-steps, steps + 1)
              if math.hypot(dx, dy) <= steps]
    offsets = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in around))
    seen = (weights.withColumn("o", F.explode(offsets))
            .groupBy((F.col("gx") + F.col("o.dx")).alias("gx"), (F.col("gy") + F.col("o.dy")).alias("gy"))
            .agg(F.sum("weight").alias("near")))
    dense = weights.join(seen.where(F.col("near") >= min_samples), ["gx", "gy"]).select("gx", "gy", "weight", "node")
    other = (dense.withColumn("o", F.explode(offsets)).where("o.dx > 0 OR (o.dx = 0 AND o.dy > 0)")
             .select((F.col("gx") + F.col("o.dx")).alias("gx"), (F.col("gy") + F.col("o.dy")).alias("gy"),
                     F.col("node").alias("a")))
    links = dense.join(other, ["gx", "gy"]).select(F.lit(0).cast("bigint").alias("drawing_id"), "a",
                                                   F.col("node").alias("b"))
    found = connected_components(links).select("node", "component")
    labelled = dense.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = labelled.groupBy("component").agg(F.sum("weight").alias("n")).where(F.col("n") >= min_size)
    numbered = with_position(sizes, [], [F.desc("n"), "component"], "cluster_id").select("component", "cluster_id")
    chosen = labelled.join(numbered, "component").select("gx", "gy", "cluster_id")
    return (placed.join(chosen, ["gx", "gy"], "left")
            .withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1).cast("bigint"))).drop("gx", "gy"))


def move_rows(clusters: DataFrame, moves: DataFrame, row_id: str) -> DataFrame:
    """Rows after edits (seq, row_id, target): a null target opens the next new cluster.

    All rows of one edit share its new cluster; the last move of a row holds.
    """
    highest = clusters.agg(F.max("cluster_id")).scalar()
    opened = with_position(moves.where("target IS NULL").select("seq").distinct(), [], ["seq"], "nth")
    given = (moves.join(opened, "seq", "left")
             .withColumn("to", F.coalesce(F.col("target"), highest + 1 + F.col("nth"))))
    last = given.groupBy(row_id).agg(F.max_by("to", "seq").alias("to"))
    return (clusters.join(last, row_id, "left")
            .withColumn("cluster_id", F.coalesce("to", "cluster_id")).drop("to"))

"""Counts, extents and selections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetweave.functions import geometry as g
from sheetweave.functions import textrules
from sheetweave.functions.geometry import box
from sheetweave.operators.ordering import with_position


def category_counts(symbols: DataFrame) -> DataFrame:
    """Symbols per category, and whether the category is discarded."""
    return (symbols.groupBy("drawing_id", "category").agg(F.count("*").alias("n"))
            .withColumn("discarded", textrules.is_discarded(F.col("category"))))


def count_clusters(symbols: DataFrame) -> DataFrame:
    """Number of clusters of each drawing, noise (-1) left out."""
    return symbols.groupBy("drawing_id").agg(
        F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("num_clusters"))


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """Size and share of every cluster; -1 is noise."""
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).scalar()
    return sizes.select("cluster_id", "n", (F.col("n") / total).alias("share"))


def top_categories(symbols: DataFrame) -> DataFrame:
    """Categories of a drawing by count, largest first, then by name."""
    counts = symbols.groupBy("drawing_id", "category").agg(F.count("*").alias("n"))
    return with_position(counts, ["drawing_id"], [F.desc("n"), "category"], "place")


def extents(nodes: DataFrame, links: DataFrame, texts: DataFrame, pages: DataFrame) -> DataFrame:
    """Largest coordinates of a drawing against the size of its page."""
    parts = [df.select("drawing_id", F.greatest("x1", "x2").alias("x"), F.greatest("y1", "y2").alias("y"))
             for df in (nodes, links, texts)]
    far = (parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("drawing_id")
           .agg(F.greatest(F.lit(0), F.max("x")).alias("max_x"), F.greatest(F.lit(0), F.max("y")).alias("max_y")))
    larger = (F.col("max_x") > F.col("width") * 1.1) | (F.col("max_y") > F.col("height") * 1.1)
    smaller = (F.col("max_x") < F.col("width") * 0.5) | (F.col("max_y") < F.col("height") * 0.5)
    return far.join(pages, "drawing_id").select(
        "drawing_id", "max_x", "max_y", larger.alias("space_larger"),
        (smaller & ~larger).alias("space_smaller"))


def score_stats(detections: DataFrame, threshold: float = 0.5, batch: int = 64) -> DataFrame:
    """Score range and hits per batch of prompts."""
    return (detections.groupBy("drawing_id", F.floor(F.col("det_id") / batch).alias("batch"))
            .agg(F.min("score").alias("low"), F.max("score").alias("high"),
                 F.count_if(F.col("score") >= threshold).alias("above")))


def area_stats(features: DataFrame) -> DataFrame:
    return features.groupBy("drawing_id").agg(
        F.min("area").alias("low"), F.max("area").alias("high"), F.avg("area").alias("mean"))


def split_counts(symbols: DataFrame, splits: DataFrame) -> DataFrame:
    """Drawings and symbols per split."""
    per_drawing = symbols.groupBy("drawing_id").agg(F.count("*").alias("n"))
    return (splits.join(per_drawing, "drawing_id").groupBy("split")
            .agg(F.count("*").alias("images"), F.sum("n").alias("symbols")))


def selection_stats(selected: DataFrame, order: str) -> DataFrame:
    """Count, area, mean score and the text of a selection in its order."""
    words = F.sort_array(F.collect_list(F.struct(order, "text")))
    return selected.groupBy("drawing_id").agg(
        F.count("*").alias("n"), F.sum(g.area(box())).alias("total_area"),
        F.avg("score").alias("mean_score"), F.array_join(words["text"], " ").alias("combined"))


def combined_direction(direction: Column) -> Column:
    """Aggregate: the one direction given, several become bidirectional."""
    given = F.when(direction != "none", direction)
    low, high = F.min(given), F.max(given)
    return (F.when(low.isNull(), "none").when(low == high, low).otherwise("bidirectional"))


def _farthest(points: pd.DataFrame) -> tuple[int, int]:
    """Rows of the farthest pair, the first one in order of idx on equal distances."""
    points = points.sort_values(["px", "py"], kind="stable")
    xs, ys = points["px"].to_numpy(), points["py"].to_numpy()

    def half_hull(order):
        hull: list[int] = []
        for i in order:
            while len(hull) > 1:
                a, b = hull[-2], hull[-1]
                if (xs[b] - xs[a]) * (ys[i] - ys[a]) - (ys[b] - ys[a]) * (xs[i] - xs[a]) > 0:
                    break
                hull.pop()
            hull.append(i)
        return hull

    n = len(points)
    hull = sorted(set(half_hull(range(n)) + half_hull(range(n - 1, -1, -1))),
                  key=lambda i: points["idx"].iat[i])
    hx, hy = xs[hull].astype(float), ys[hull].astype(float)
    best, pair = -1.0, (0, 0)
    for i in range(len(hull) - 1):
        squares = (hx[i + 1:] - hx[i]) ** 2 + (hy[i + 1:] - hy[i]) ** 2
        j = int(np.argmax(squares))
        if squares[j] > best:
            best, pair = squares[j], (i, i + 1 + j)
    return points.index[hull[pair[0]]], points.index[hull[pair[1]]]


def farthest_pair(points: DataFrame, keys: list[str]) -> DataFrame:
    """The two points of each group that lie farthest apart, from (keys, idx, px, py).

    Only the lowest and the highest point of a pixel column can be a corner of
    the hull, so the rows that reach one task are at most two per pixel column.
    """
    at = points.groupBy(*keys, "px").agg(
        F.min(F.struct("py", "idx")).alias("low"),
        F.max_by(F.struct("py", "idx"), F.struct("py", -F.col("idx"))).alias("high"))
    corners = at.select(*keys, "px", F.explode(F.array_distinct(F.array("low", "high"))).alias("p")).select(
        *keys, "px", F.col("p.py").alias("py"), F.col("p.idx").alias("idx"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}"
                       for f in points.select(*keys).schema.fields)

    def pick(packed: pd.DataFrame) -> pd.DataFrame:
        """Many groups in one call: the ends of each group's pair, by their rows in the batch."""
        ends, owners = [], []
        for _, rows in packed.groupby(keys, sort=False, dropna=False):
            ends.append(_farthest(rows) if len(rows) > 1 else (rows.index[0], rows.index[0]))
            owners.append(rows.index[0])
        a, b = (packed.loc[list(side), ["px", "py"]].to_numpy() for side in zip(*ends))
        out = packed.loc[owners, keys].reset_index(drop=True)
        out["x1"], out["y1"], out["x2"], out["y2"] = a[:, 0], a[:, 1], b[:, 0], b[:, 1]
        return out

    kind = points.schema["px"].dataType.simpleString()
    schema = f"{fields}, x1 {kind}, y1 {kind}, x2 {kind}, y2 {kind}"
    bins = 4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    binned = corners.withColumn("bin", F.pmod(F.xxhash64(*keys), F.lit(bins)))
    return binned.groupBy("bin").applyInPandas(pick, schema)


def even_sample(rows: DataFrame, group: str, order: str, size: int = 32) -> DataFrame:
    """At most ``size`` rows per group, evenly spread: rows int(i * n / size)."""
    placed = with_position(rows, [group], [order])
    counts = rows.groupBy(group).agg(F.count("*").alias("n"))
    i = F.ceil(F.col("position") * size / F.col("n"))
    chosen = (F.col("n") <= size) | ((i < size) & (F.floor(i * F.col("n") / size) == F.col("position")))
    return placed.join(counts, group).where(chosen).drop("n")


def cluster_order(clusters: DataFrame, row_id: str) -> DataFrame:
    """Clusters by size, largest first, noise last; with the id of the next new one."""
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("n"), F.min(row_id).alias("first"))
    placed = with_position(sizes, [], [F.expr("cluster_id = -1"), F.desc("n"), "first"], "place")
    new = sizes.agg(F.max("cluster_id") + 1).scalar()
    return placed.select("cluster_id", "n", "place", new.alias("next_id"))


def exact_duplicates(lines: DataFrame) -> DataFrame:
    """Lines without later copies of the same two endpoints in either order."""
    ends = F.sort_array(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")),
                                F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))))
    names = [c for c in lines.columns if c != "drawing_id"]
    return (lines.groupBy("drawing_id", "line_type", ends.alias("ends"))
            .agg(F.min_by(F.struct(*names), "line_id").alias("first"), F.count("*").alias("copies"))
            .select("drawing_id", "first.*", "copies"))


def first_of_group(rows: DataFrame, keys: list[str], order: list, top: int) -> DataFrame:
    """The first rows of each group; Spark cuts groups before the shuffle already."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", place).where(F.col("rank") <= top)

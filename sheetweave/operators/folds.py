"""Order-dependent merges, exact, without a task per drawing.

Lines, texts and masks that grow as they take in others go through the tile fold
(tilefold.py). Paths and editor lines look for a next part again after each step; their ends
are ends of their parts, so they never leave a connected component of lines with near
ends, and every component is folded on its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetweave.functions import textrules
from sheetweave.operators import foldrules, graph
from sheetweave.operators.components import connected_components
from sheetweave.operators.filters import long_enough, without_junk
from sheetweave.operators.joining import large
from sheetweave.operators.tilefold import CAPACITY, fold
from sheetweave.scratch import Scratch

PLACE = ["x1", "y1", "x2", "y2"]
NODE = ["drawing_id", "id"]
ROWS_PER_TASK = 20_000


def fold_components(items: DataFrame, labels: DataFrame, fold: Callable[[pd.DataFrame], list],
                    schema: str) -> DataFrame:
    """Applies the fold to the items of every labelled (drawing_id, component).

    Many small components share one call into Python. Labels are a written table.
    """
    spark = items.sparkSession
    rows = items.join(large(labels), [c for c in labels.columns if c != "component"])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bins = max(parts, math.ceil(labels.count() / ROWS_PER_TASK))
    drawing_type = rows.schema["drawing_id"].dataType.simpleString()
    schema = f"drawing_id {drawing_type}, component bigint, {schema}"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(packed: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (drawing, component), part in packed.groupby(["drawing_id", "component"], sort=False):
            out += [(drawing, component, *row) for row in fold(part)]
        return pd.DataFrame(out, columns=names)

    binned = rows.withColumn("bin", F.pmod(F.xxhash64("drawing_id", "component"), F.lit(bins)))
    return binned.groupBy("bin").applyInPandas(run, schema)


def _boxes(part: pd.DataFrame) -> np.ndarray:
    return part[PLACE].to_numpy()


def _renamed(df: DataFrame, id_column: str) -> DataFrame:
    return df.withColumnRenamed(id_column, "id")


# --- lines -------------------------------------------------------------------


def dedup_lines(lines: DataFrame, distance: float = 25.0, capacity: int = CAPACITY) -> DataFrame:
    """Of lines with both ends near each other the longer one, in order of their ids."""
    kept = fold(_renamed(lines, "line_id").select(*NODE, *PLACE), foldrules.NearCopies(distance), capacity)
    return lines.join(large(kept.selectExpr("drawing_id", "id line_id")), ["drawing_id", "line_id"], "left_semi")


def merge_segments(lines: DataFrame, min_length: float = 15.0, dedup_distance: float = 25.0,
                   capacity: int = CAPACITY) -> DataFrame:
    """Long enough lines, without near copies, collinear ones merged until none is left to merge.

    A merged line keeps the id of its first part. Returns (drawing_id, line_id, x1 .. y2).
    """
    items = _renamed(long_enough(lines, min_length), "line_id").select(*NODE, *PLACE)
    clean = fold(items, foldrules.NearCopies(dedup_distance), capacity)
    return fold(clean, foldrules.Segments(), capacity).withColumnRenamed("id", "line_id")


def merge_editor_lines(lines: DataFrame, distance: float = 15.0, angle: float = 5.0,
                       min_length: float = 0.0) -> DataFrame:
    """Collinear lines of one type with near ends joined.

    The ends of a joined line are ends of its parts, so components over near
    ends are closed already.
    """
    lines = long_enough(lines, min_length)
    columns = ["drawing_id", "line_id", "line_type", "direction", *PLACE]
    links = graph.endpoint_links(lines, distance + 1e-6)
    scratch = Scratch(lines.sparkSession)
    labels = scratch.save(connected_components(links).withColumnRenamed("node", "line_id"))
    key = ["drawing_id", "line_id"]

    def join(part):
        part = part.sort_values("line_id")
        kind = part["line_type"].iat[0]
        rows = foldrules.join_editor_lines(part["line_id"].to_numpy(), _boxes(part),
                                           list(part["direction"]), distance, angle)
        return [(i, kind, direction, *ends) for i, *ends, direction in rows]

    joined = fold_components(
        lines.select(*columns), labels, join,
        "line_id bigint, line_type string, direction string, "
        "x1 bigint, y1 bigint, x2 bigint, y2 bigint").drop("component")
    return lines.select(*columns).join(large(labels), key, "left_anti").unionByName(joined)


def chain_lines(lines: DataFrame, max_line_distance: float = 50.0) -> DataFrame:
    """Members of paths: (drawing_id, chain_id, member_pos, start, all columns of the lines).

    A path never leaves a component of same-type lines with near endpoints; its
    id is its lowest line.
    """
    reach = max_line_distance * 0.5
    key = ["drawing_id", "line_id"]
    scratch = Scratch(lines.sparkSession)
    labels = scratch.save(connected_components(graph.endpoint_links(lines, reach))
                          .withColumnRenamed("node", "line_id"))

    def walk(part):
        return foldrules.walk_chains(part["line_id"].to_numpy(), _boxes(part), reach)

    walked = fold_components(
        lines.select(*key, *PLACE), labels, walk,
        "chain_id bigint, member_pos bigint, line_id bigint")
    single = (lines.select(*key).join(large(labels), key, "left_anti")
              .selectExpr("drawing_id", "line_id chain_id", "0L member_pos", "line_id"))
    members = scratch.save(walked.drop("component").unionByName(single))
    return graph.member_offsets(members.join(large(lines), key), ["drawing_id", "chain_id"])


def line_networks(lines: DataFrame, max_line_distance: float = 50.0) -> DataFrame:
    """Lines with their network: same-type lines tied together by near endpoints."""
    labels = connected_components(graph.endpoint_links(lines, max_line_distance * 0.5))
    return (lines.join(large(labels.withColumnRenamed("node", "line_id")), ["drawing_id", "line_id"], "left")
            .withColumn("network", F.coalesce("component", "line_id")).drop("component"))


# --- texts -------------------------------------------------------------------

def merge_close_texts(texts: DataFrame, y_tolerance: float = 6, x_gap: float = 12,
                      capacity: int = CAPACITY) -> DataFrame:
    """Texts of one row that follow closely appended to the first; its score is kept."""
    items = _renamed(texts.select("drawing_id", "text_id", *PLACE, "text", "score"), "text_id")
    return fold(items, foldrules.CloseTexts(y_tolerance, x_gap), capacity).withColumnRenamed("id", "text_id")


def _merge_texts(texts: DataFrame, vertical: bool, capacity: int) -> DataFrame:
    merged = fold(_renamed(texts, "text_id"), foldrules.MergedTexts(vertical), capacity)
    return merged.withColumnRenamed("id", "text_id")


def _prepared(texts: DataFrame, pages: DataFrame) -> DataFrame:
    page = pages.select("drawing_id", F.col("width").alias("page_width"))
    return (texts.join(page, "drawing_id").withColumn("text", textrules.normalise(F.col("text")))
            .select("drawing_id", "text_id", *PLACE, "text", "score", "page_width"))


def merge_horizontal(texts: DataFrame, pages: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Parts of tags and words of one row joined; pages are (drawing_id, width)."""
    return _merge_texts(_prepared(texts, pages), False, capacity)


def merge_vertical(texts: DataFrame, pages: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Word lines of one block joined."""
    return _merge_texts(_prepared(texts, pages), True, capacity)


def merge_text_items(texts: DataFrame, pages: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows first, then blocks, then junk removed."""
    rows = _merge_texts(_prepared(texts, pages), False, capacity)
    return without_junk(_merge_texts(rows, True, capacity)).drop("page_width")


# --- masks -------------------------------------------------------------------


def merge_masks(masks: DataFrame, runs: DataFrame, features: DataFrame, iou_limit: float = 0.8,
                reach: int = 20, capacity: int = CAPACITY // 32) -> DataFrame:
    """Overlapping and neighbouring masks of one symbol united, best score first.

    Masks are (drawing_id, mask_id, score), features their box and area. Returns
    (drawing_id, mask_id, x1 .. y2, area, score, members); the pixels of a result
    are the union of its members' runs.
    """
    key = ["drawing_id", "mask_id"]
    # The runs of one mask are as many as its rows of pixels have pieces.
    pixels = runs.where("x_end > x_start").groupBy(*key).agg(
        F.collect_list(F.struct("y", "x_start", "x_end")).alias("runs")).select(
        *key, F.col("runs.y").alias("ys"), F.col("runs.x_start").alias("starts"), F.col("runs.x_end").alias("ends"))
    items = (_renamed(masks.join(large(features), key).join(large(pixels), key), "mask_id")
             .select(*NODE, *PLACE, "area", "score", F.array("id").alias("members"), "ys", "starts", "ends"))
    merged = fold(items, foldrules.Masks(iou_limit, reach), capacity)
    return merged.withColumnRenamed("id", "mask_id").drop("ys", "starts", "ends")

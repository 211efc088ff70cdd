"""Greedy suppression: the best box left is taken, and all boxes in conflict with it are dropped.

That is an ordered fold whose groups do not grow: in order of rank a box joins the first kept
box in conflict with it, or is kept. See tilefold.py for drawings of many boxes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sheetweave.operators.foldrules import Suppressed
from sheetweave.operators.joining import large
from sheetweave.operators.tilefold import CAPACITY, fold

NODE = ["drawing_id", "id"]
#: Tells which of some boxes (rows of x1 .. y2) are in conflict with a box; they must overlap.
Conflict = Callable[[np.ndarray, np.ndarray], np.ndarray]


def suppress(boxes: DataFrame, conflict: Conflict, capacity: int = CAPACITY) -> DataFrame:
    """Boxes that survive, from (drawing_id, id, score, x1, y1, x2, y2).

    The rank is the score, descending, then the id; boxes without a score come last.
    """
    return fold(boxes, Suppressed(conflict), capacity).select(*NODE, "score", "x1", "y1", "x2", "y2")


def absorbed_by(boxes: DataFrame, conflict: Conflict, capacity: int = CAPACITY) -> DataFrame:
    """(drawing_id, id, seed): each box with the best kept box it is in conflict with; a kept one is its own."""
    dropped = fold(boxes, Suppressed(conflict), capacity, parts=True).withColumnRenamed("owner", "seed")
    return (boxes.select(*NODE).join(large(dropped), NODE, "left")
            .withColumn("seed", F.coalesce("seed", "id")))

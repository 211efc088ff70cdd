"""Single edits over tables; editlog.py tells which edits of a log are in force."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetweave.functions import geometry as g
from sheetweave.functions import textrules
from sheetweave.functions.geometry import box
from sheetweave.operators.aggregates import combined_direction, farthest_pair
from sheetweave.operators.joining import large
from sheetweave.operators.masks import union_masks
from sheetweave.operators.ordering import with_position

PLACE = ["x1", "y1", "x2", "y2"]


def without(rows: DataFrame, deleted: DataFrame, id_column: str) -> DataFrame:
    """Rows that are not deleted; deleted is (drawing_id, id_column)."""
    key = ["drawing_id", id_column]
    return rows.join(large(deleted.select(*key)), key, "left_anti")


def combine_masks(masks: DataFrame, runs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Selections (drawing_id, selection, mask_id) of two or more united, mean score, lowest id.

    Masks are (drawing_id, mask_id, score, x1 .. y2, area).
    """
    key = ["drawing_id", "mask_id"]
    first = (chosen.groupBy("drawing_id", "selection")
             .agg(F.min("mask_id").alias("lowest"), F.count("*").alias("n")).where("n >= 2"))
    picked = chosen.join(large(first), ["drawing_id", "selection"]).select(*key, "lowest")
    scored = masks.select(*key, "score").join(large(picked), key)
    _, united = union_masks(runs, scored, "lowest")  # meets the runs of scored masks alone
    combined = united.select("drawing_id", F.col("lowest").alias("mask_id"), F.col("mean_score").alias("score"),
                             *PLACE, "area")
    return without(masks.select(*combined.columns), picked, "mask_id").unionByName(combined)


def combine_texts(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Selections (drawing_id, selection, text_id, place) of two or more joined in their order."""
    key = ["drawing_id", "text_id"]
    sizes = chosen.groupBy("drawing_id", "selection").agg(F.count("*").alias("n")).where("n >= 2")
    picked = chosen.join(large(sizes), ["drawing_id", "selection"], "left_semi")
    words = F.sort_array(F.collect_list(F.struct("place", "text")))
    combined = texts.join(large(picked), key).groupBy("drawing_id", "selection").agg(
        F.min("text_id").alias("text_id"), F.min("x1").alias("x1"), F.min("y1").alias("y1"),
        F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        F.array_join(words["text"], " ").alias("text"), F.avg("score").alias("score")).drop("selection")
    return without(texts.select(*combined.columns), picked, "text_id").unionByName(combined)


def combine_lines(lines: DataFrame, chosen: DataFrame, keep_selection: bool = False) -> DataFrame:
    """Selections (drawing_id, selection, line_id) of one type become the line between their furthest ends.

    Selections of one line or of both types are left alone; new lines come last. With ``keep_selection``
    the new lines alone come back, with the selection as their id.
    """
    group = ["drawing_id", "selection"]
    members = lines.join(large(chosen), ["drawing_id", "line_id"])
    valid = members.groupBy(*group).agg(
        F.count("*").alias("n"), F.min("line_type").alias("line_type"), F.max("line_type").alias("other"),
        combined_direction(F.col("direction")).alias("direction")).where("n >= 2 AND line_type = other")
    parts = members.join(large(valid.select(*group)), group, "left_semi")
    ends = F.array(F.struct(F.expr("line_id*2 idx"), F.col("x1").alias("px"), F.col("y1").alias("py")),
                   F.struct(F.expr("line_id*2+1 idx"), F.col("x2").alias("px"), F.col("y2").alias("py")))
    furthest = farthest_pair(parts.select(*group, F.explode(ends).alias("e")).select(*group, "e.*"), group)
    if keep_selection:
        return furthest.join(large(valid), group).select(
            "drawing_id", F.col("selection").alias("line_id"), "line_type", "direction", *PLACE)
    last = lines.groupBy("drawing_id").agg(F.max("line_id").alias("last"))
    placed = with_position(furthest.join(large(valid), group), ["drawing_id"], ["selection"], "nth")
    new = placed.join(last, "drawing_id").select(
        "drawing_id", (F.col("last") + 1 + F.col("nth")).alias("line_id"), "line_type", "direction", *PLACE)
    return without(lines.select(*new.columns), parts, "line_id").unionByName(new)


def resize_boxes(masks: DataFrame, changes: DataFrame, pages: DataFrame) -> DataFrame:
    """New boxes (drawing_id, mask_id, x1 .. y2) clamped to the page; others stay."""
    key = ["drawing_id", "mask_id"]
    clamped = g.clamp_box(box("n_"), F.col("width"), F.col("height"))
    new = changes.select(*key, *(F.col(c).alias(f"n_{c}") for c in PLACE)).join(pages, "drawing_id").select(
        *key, *(c.alias(f"n_{name}") for c, name in zip(clamped, PLACE)))
    joined = masks.join(large(new), key, "left")
    return joined.withColumns({c: F.coalesce(f"n_{c}", c) for c in PLACE}).drop(*(f"n_{c}" for c in PLACE))


def create_boxes(drawn: DataFrame, pages: DataFrame) -> DataFrame:
    """Drawn rectangles of at least five pixels each way, clamped, with score 1."""
    b = g.bounds(box())
    big = drawn.where((g.width(b) >= 5) & (g.height(b) >= 5)).join(pages, "drawing_id")
    clamped = g.clamp_box(b, F.col("width"), F.col("height"))
    return big.select("drawing_id", "seq", *(c.alias(n) for c, n in zip(clamped, PLACE)), F.lit(1.0).alias("score"))


def create_lines(drawn: DataFrame) -> DataFrame:
    """Drawn lines of at least five pixels, with the type and direction chosen."""
    return drawn.where(g.segment_length(box()) >= 5)


def set_texts(texts: DataFrame, changes: DataFrame) -> DataFrame:
    """Last new text (drawing_id, text_id, seq, value) of each item."""
    key = ["drawing_id", "text_id"]
    last = changes.groupBy(*key).agg(F.max_by("value", "seq").alias("value"))
    return texts.join(large(last), key, "left").withColumn("text", F.coalesce("value", "text")).drop("value")


def set_directions(lines: DataFrame, changes: DataFrame) -> DataFrame:
    """Last direction set, (drawing_id, line_id, seq, value)."""
    key = ["drawing_id", "line_id"]
    last = changes.groupBy(*key).agg(F.max_by("value", "seq").alias("value"))
    return lines.join(large(last), key, "left").withColumn("direction", F.coalesce("value", "direction")).drop("value")


def cycle_directions(lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen lines (drawing_id, line_id) get the next direction of the cycle."""
    key = ["drawing_id", "line_id"]
    hit = chosen.select(*key).distinct().withColumn("hit", F.lit(True))
    joined = lines.join(large(hit), key, "left")
    return joined.withColumn("direction", F.when(
        F.col("hit"), textrules.next_direction(F.col("direction"))).otherwise(F.col("direction"))).drop("hit")


def renumber(rows: DataFrame, id_column: str) -> DataFrame:
    """Ids become places in the list again."""
    return with_position(rows, ["drawing_id"], [id_column], "new_id")

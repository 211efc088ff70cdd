"""Binary masks as run-length rows (drawing_id, mask_id, y, x_start, x_end).

Runs are half-open, and the runs of one mask do not overlap each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from sheetweave.operators.joining import large
from sheetweave.operators.spatial import dealt

STRIP = 64
ROW = ["drawing_id", "y", "strip"]
#: Runs that a task sorts at once.
SHARE = 1_000_000
#: Rows of pixels that go to one task together, pixels between runs that are read as one piece, pixels summed at once.
BAND, NEAR, BLOCK = 32, 64, 1 << 18
#: Places beyond are as this one: an array has no more elements.
FARTHEST = (1 << 31) - 2


def rectangle_runs(boxes: DataFrame, id_column: str) -> DataFrame:
    """One run per row of pixels of each box."""
    return (boxes.where("y2 > y1 AND x2 > x1")
            .select("drawing_id", F.col(id_column).alias("mask_id"),
                    F.explode(F.sequence(F.col("y1"), F.col("y2") - 1)).alias("y"),
                    F.col("x1").alias("x_start"), F.col("x2").alias("x_end")))


def stored_or_rectangles(runs: DataFrame, detections: DataFrame) -> DataFrame:
    """Stored masks; rectangles of the boxes for drawings without any."""
    without = detections.join(runs.select("drawing_id").distinct(), "drawing_id", "left_anti")
    return runs.unionByName(rectangle_runs(without, "det_id"))


def mask_features(runs: DataFrame, keys: tuple[str, ...] = ("drawing_id", "mask_id")) -> DataFrame:
    """Tight half-open box and area of each mask."""
    return runs.where("x_end > x_start").groupBy(*keys).agg(
        F.min("x_start").alias("x1"), F.min("y").alias("y1"),
        F.max("x_end").alias("x2"), (F.max("y") + 1).alias("y2"),
        F.sum(F.col("x_end") - F.col("x_start")).alias("area"))


def features_of_all(masks: DataFrame, runs: DataFrame) -> DataFrame:
    """The same for every listed mask; an empty one has zeros."""
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("x1", "y1", "x2", "y2", "area")}
    return masks.join(large(mask_features(runs)), ["drawing_id", "mask_id"], "left").withColumns(zero)


def in_strips(runs: DataFrame, width: int = STRIP) -> DataFrame:
    """Runs spread over vertical strips; ``low`` is the first strip."""
    low = F.floor(F.col("x_start") / width)
    high = F.floor((F.col("x_end") - 1) / width)
    return (runs.where("x_end > x_start").withColumn("low", low)
            .withColumn("strip", F.explode(F.sequence(low, high))))


def overlaps(left: DataFrame, right: DataFrame, ordered: bool = False) -> DataFrame:
    """(drawing_id, a, b, pixels) for masks that share pixels; ``ordered`` asks a < b."""
    a = in_strips(left).select(*ROW, F.col("mask_id").alias("a"), F.col("x_start").alias("a1"),
                               F.col("x_end").alias("a2"), F.col("low").alias("a_low"))
    b = in_strips(right).select(*ROW, F.col("mask_id").alias("b"), F.col("x_start").alias("b1"),
                                F.col("x_end").alias("b2"), F.col("low").alias("b_low"))
    a, b, on = dealt(a, b, ROW)
    pairs = a.join(large(b), on).where((F.col("strip") == F.greatest("a_low", "b_low"))
                                 & (F.col("a1") < F.col("b2")) & (F.col("b1") < F.col("a2")))
    if ordered:
        pairs = pairs.where("a < b")
    shared = F.least("a2", "b2") - F.greatest("a1", "b1")
    return pairs.groupBy("drawing_id", "a", "b").agg(F.sum(shared).alias("pixels"))


def union_runs(runs: DataFrame, group: str) -> DataFrame:
    """Runs of the union of all masks of a group, merged where they touch or overlap.

    Runs with one start are folded first, so the window sees at most as many
    rows per row of pixels as the page is wide.
    """
    row = ["drawing_id", group, "y"]
    longest = (runs.where("x_end > x_start").groupBy(*row, "x_start")
               .agg(F.max("x_end").alias("x_end")))
    order = Window.partitionBy(*row).orderBy("x_start")
    reached = F.max("x_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = longest.withColumn("_new", F.when(F.col("x_start") <= reached, 0).otherwise(1))
    island = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (opened.withColumn("_island", island).groupBy(*row, "_island")
            .agg(F.min("x_start").alias("x_start"), F.max("x_end").alias("x_end")).drop("_island"))


def union_masks(runs: DataFrame, masks: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Union per group: its runs, and its box, area, mean and best score.

    Masks are (drawing_id, mask_id, score, group). The tasks that sort runs grow in number with them, so
    that none sorts more than about ``SHARE`` (or the runs of one mask, or of one row of pixels of a group).
    The rows of a group are dealt out once, for all steps of the union.
    """
    tasks = max(1, -(-runs.count() // SHARE))
    tagged = (runs.repartition(tasks, "drawing_id", "mask_id")
              .join(large(masks.select("drawing_id", "mask_id", group)), ["drawing_id", "mask_id"]))
    merged = union_runs(tagged.repartition(tasks, "drawing_id", group, "y"), group)
    scores = masks.groupBy("drawing_id", group).agg(
        F.avg("score").alias("mean_score"), F.max("score").alias("best_score"),
        F.count("*").alias("members"))
    return merged, mask_features(merged, ("drawing_id", group)).join(large(scores), ["drawing_id", group])


def pixel_stats(runs: DataFrame, pixel_rows: DataFrame) -> DataFrame:
    """Grey statistics of the pixels under each mask.

    Pixel rows are (drawing_id, y, grey ARRAY). Runs of one row of pixels that are near each other form
    a piece; a row is read piece by piece, in bands of rows that go to one task together, so pixels far from
    all masks are not looked at and others once a piece. Sums from the start of a piece are made once, and a
    run takes the difference of two of them. Sums of the masks in a batch leave the task, no row per pixel
    or run. Whole numbers make the result independent of the order. Parts of runs beyond the row have no
    pixels. Tasks grow in number with the runs, as each keeps the runs of its bands in memory.
    """
    placed = runs.where("x_end > x_start AND x_end > 0 AND drawing_id IS NOT NULL AND y IS NOT NULL").select(
        "drawing_id", "mask_id", "y", *(F.expr(f"CAST(greatest(least({c}, {FARTHEST}), 0) AS INT) {c}")
                                        for c in ("x_start", "x_end")))
    kinds, share, block = placed.schema, SHARE, BLOCK
    tasks = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-placed.count() // share))
    band = F.expr(f"y div {BAND}").alias("band")
    numbers = ArrayType(IntegerType())
    fields = [kinds["drawing_id"], kinds["y"], StructField("low", IntegerType()), StructField("high", IntegerType()),
              StructField("masks", ArrayType(kinds["mask_id"].dataType)), StructField("starts", numbers),
              StructField("ends", numbers)]

    def gather(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= share:
                yield _pieces(held)
                held, rows = [], 0
        if rows:
            yield _pieces(held)

    def measure(batches):
        for batch in batches:
            if batch.num_rows:
                yield _run_sums(batch, block)

    pieces = (placed.mapInArrow(gather, StructType(fields)).select("*", band)
              .withColumnRenamed("y", "own_y").repartition(tasks, "drawing_id", "band").hint("shuffle_hash"))
    rows = pixel_rows.select("drawing_id", "y", "grey", band).repartition(tasks, "drawing_id", "band")
    # As an equality the rows would be a key, and Spark would deal out the rows of a band one by one.
    met = rows.join(pieces, ["drawing_id", "band"]).where("y BETWEEN own_y AND own_y").select(
        "drawing_id", "masks", "starts", "ends",
        F.expr("slice(grey, low + 1, greatest(least(high, size(grey)) - low, 0))").alias("grey"))
    sums = met.mapInArrow(measure, StructType([kinds["drawing_id"], kinds["mask_id"], *(
        StructField(c, LongType()) for c in _SUMS)])).groupBy("drawing_id", "mask_id").agg(
        *(F.sum(c).alias(c) for c in _SUMS))
    spread = F.sqrt((F.col("pixels") * F.col("q") - F.col("s") * F.col("s")).cast("double"))
    return sums.where("pixels > 0").select(
        "drawing_id", "mask_id", "pixels", (F.col("white") / F.col("pixels")).alias("white_share"),
        (spread / F.col("pixels")).alias("std"))


_SUMS = ["pixels", "s", "q", "white"]


def _pieces(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Pieces of rows of pixels, each with its runs; starts and ends count from the start of the piece."""
    drawing, mask, y, start, end = (c.combine_chunks() for c in pa.Table.from_batches(batches).columns)
    page = drawing.dictionary_encode().indices.to_numpy().astype(np.int64)
    row, start, end = (c.to_numpy().astype(np.int64) for c in (y, start, end))
    order = np.lexsort((start, row, page))
    page, row, start, end = (c[order] for c in (page, row, start, end))
    # Rows of pixels laid end to end, so far apart that no piece goes on to the next.
    first = np.concatenate(([True], (page[1:] != page[:-1]) | (row[1:] != row[:-1])))
    base = np.cumsum(first) << 32
    reach = np.maximum.accumulate(base + end)
    opens = np.flatnonzero(np.concatenate(([True], base[1:] + start[1:] > reach[:-1] + NEAR)))
    closes = np.append(opens[1:], len(order))
    low, high = start[opens], (reach - base)[closes - 1]
    own = np.repeat(low, closes - opens)
    offsets = pa.array(np.append(opens, len(order)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, c) for c in (
        mask.take(pa.array(order)), pa.array((start - own).astype(np.int32)), pa.array((end - own).astype(np.int32)))]
    there = pa.array(order[opens])
    return pa.RecordBatch.from_arrays(
        [drawing.take(there), y.take(there), *(pa.array(c.astype(np.int32)) for c in (low, high)), *lists],
        names=["drawing_id", "y", "low", "high", "masks", "starts", "ends"])


def _run_sums(batch: pa.RecordBatch, block: int) -> pa.RecordBatch:
    """Pixels, sum, sum of squares and white pixels of each mask under the pieces of a batch."""
    drawing, masks, starts, ends, grey = batch.columns
    sizes = grey.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    held = masks.value_lengths().to_numpy()
    values = grey.flatten().fill_null(0).to_numpy(zero_copy_only=False)
    first, run = (np.concatenate(([0], np.cumsum(c))) for c in (sizes, held))
    piece = np.repeat(np.arange(batch.num_rows), held)
    low, high = (first[piece] + np.minimum(c.flatten().to_numpy(), sizes[piece]) for c in (starts, ends))
    found = np.empty((len(_SUMS), len(piece)), dtype=np.int64)
    found[0] = high - low
    # Pieces that start in one block of pixels: the sums stay in the processor's cache.
    cuts = [0, *(np.flatnonzero(np.diff(first[:-1] // block)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        grey_values = values[first[a]:first[b]].astype(np.int64)
        runs = slice(run[a], run[b])
        left, right = low[runs] - first[a], high[runs] - first[a]
        total = np.zeros(len(grey_values) + 1, dtype=np.int64)
        for n, what in enumerate((grey_values, grey_values * grey_values, grey_values > 240), 1):
            np.cumsum(what, out=total[1:])
            found[n, runs] = total[right] - total[left]
    table = pa.table([drawing.take(pa.array(piece)), masks.flatten(), *map(pa.array, found)],
                     names=["drawing_id", "mask_id", *_SUMS])
    grouped = table.group_by(["drawing_id", "mask_id"]).aggregate([(c, "sum") for c in _SUMS])
    names = ["drawing_id", "mask_id", *(f"{c}_sum" for c in _SUMS)]
    return pa.RecordBatch.from_arrays([grouped[c].combine_chunks() for c in names], names=table.column_names)


def content_verdicts(masks: DataFrame, runs: DataFrame, pixel_rows: DataFrame,
                     white_limit: float = 0.85, fill_limit: float = 0.7,
                     min_std: float = 10.0, max_aspect: float = 10.0) -> DataFrame:
    """Each mask with the first reason to drop it, null for those to keep."""
    key = ["drawing_id", "mask_id"]
    shape = mask_features(runs).withColumns({"w": F.expr("x2 - x1"), "h": F.expr("y2 - y1")})
    joined = masks.select(*key).join(large(pixel_stats(runs, pixel_rows)), key, "left").join(
        large(shape.select(*key, "w", "h", "area")), key, "left")
    elongation = F.greatest("w", "h") / F.greatest(F.least("w", "h"), F.lit(1))
    fill = F.col("area") / F.greatest(F.col("w") * F.col("h"), F.lit(1))
    reason = (F.when(F.coalesce("pixels", F.lit(0)) == 0, "empty")
              .when(F.col("white_share") > white_limit, "whitespace")
              .when((elongation > max_aspect) & (fill < fill_limit), "line")
              .when(F.col("std") < min_std, "low_variance"))
    return joined.select(*key, F.coalesce("pixels", F.lit(0)).alias("pixels"), "white_share",
                         "std", reason.alias("reason"))


def evaluate(pred: DataFrame, truth: DataFrame, batches: DataFrame) -> DataFrame:
    """IoU and Dice loss of predicted against true masks with the same id.

    Batches are (drawing_id, mask_id, batch); one row per drawing with the mean
    over batches of the mean per batch, and the mean Dice loss.
    """
    key = ["drawing_id", "mask_id"]
    same = overlaps(pred, truth).where("a = b").select(
        "drawing_id", F.col("a").alias("mask_id"), "pixels")
    p = mask_features(pred).select(*key, F.col("area").alias("p"))
    t = mask_features(truth).select(*key, F.col("area").alias("t"))
    measured = (batches.join(large(p), key, "left").join(large(t), key, "left").join(large(same), key, "left")
                .na.fill(0, ["p", "t", "pixels"]))
    iou = F.col("pixels") / (F.col("p") + F.col("t") - F.col("pixels") + 1e-6)
    dice = 1 - (2 * F.col("pixels") + 1) / (F.col("p") + F.col("t") + 1)
    per_batch = measured.groupBy("drawing_id", "batch").agg(
        F.avg(iou).alias("iou"), F.sum(dice).alias("dice"), F.count("*").alias("n"))
    return per_batch.groupBy("drawing_id").agg(
        F.avg("iou").alias("mean_iou"), (F.sum("dice") / F.sum("n")).alias("mean_dice_loss"))

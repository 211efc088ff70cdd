"""Prompt grids, tiles, negative points, splits and samples.

Chance comes from md5 of the row's own key and a seed, so results do not hang on
partitions or on a repeated task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetweave.functions import geometry as g
from sheetweave.functions.geometry import box
from sheetweave.operators.joining import large
from sheetweave.operators.masks import in_strips, STRIP
from sheetweave.operators.ordering import with_position


def _spaced(low: Column, high: Column, count: int, i: Column) -> Column:
    """Whole part of value i of ``count`` evenly spaced ones."""
    value = low + i * ((high - low) / (count - 1)) if count > 1 else low
    return F.when(i == count - 1, high).otherwise(value).cast("bigint") if count > 1 else value.cast("bigint")


def _numbers(count: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))


def grid_points(pages: DataFrame, side: int = 32) -> DataFrame:
    """(drawing_id, idx, x, y): side by side points, row by row."""
    cells = (pages.withColumn("iy", _numbers(side)).withColumn("ix", _numbers(side)))
    zero = F.lit(0).cast("bigint")
    return cells.select("drawing_id", (F.col("iy") * side + F.col("ix")).alias("idx"),
                        _spaced(zero, F.col("width") - 1, side, F.col("ix")).alias("x"),
                        _spaced(zero, F.col("height") - 1, side, F.col("iy")).alias("y"))


def grid_boxes(pages: DataFrame, side: int = 16, smallest: int = 20, largest: int = 200,
               sizes: int = 3) -> DataFrame:
    """(drawing_id, idx, x1 .. y2): boxes of several sizes around a grid, clipped to the page."""
    cells = (pages.withColumn("ix", _numbers(side)).withColumn("iy", _numbers(side))
             .withColumn("iz", _numbers(sizes)))
    low = F.lit(smallest).cast("bigint")
    placed = cells.select(
        "drawing_id", "width", "height",
        ((F.col("ix") * side + F.col("iy")) * sizes + F.col("iz")).alias("idx"),
        _spaced(low, F.col("width") - smallest, side, F.col("ix")).alias("cx"),
        _spaced(low, F.col("height") - smallest, side, F.col("iy")).alias("cy"),
        F.floor(_spaced(low, F.lit(largest).cast("bigint"), sizes, F.col("iz")) / 2).alias("half"))
    return placed.select(
        "drawing_id", "idx",
        F.greatest(F.lit(0), F.col("cx") - F.col("half")).alias("x1"),
        F.greatest(F.lit(0), F.col("cy") - F.col("half")).alias("y1"),
        F.least("width", F.col("cx") + F.col("half")).alias("x2"),
        F.least("height", F.col("cy") + F.col("half")).alias("y2"))


def _starts(size: Column, win: int, stride: int) -> Column:
    """Starts in steps, and one flush with the end when the last tile does not reach it."""
    steps = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(1), size - win + 1) - 1, F.lit(stride).cast("bigint"))
    short = F.element_at(steps, -1) + win < size
    return F.when(short, F.concat(steps, F.array(size - win))).otherwise(steps)


def tiles(pages: DataFrame, win: int = 1400, stride: int = 900) -> DataFrame:
    """(drawing_id, x, y, w, h) of the overlapping tiles of a page."""
    rows = pages.select("drawing_id", "width", F.explode(_starts(F.col("height"), win, stride)).alias("y"))
    return rows.select("drawing_id", F.explode(_starts(F.col("width"), win, stride)).alias("x"), "y",
                       F.lit(win).cast("bigint").alias("w"), F.lit(win).cast("bigint").alias("h"))


def center_prompts(symbols: DataFrame) -> DataFrame:
    """Box centres as positive points."""
    cx, cy = g.center(box())
    return symbols.select("drawing_id", "symbol_id", cx.alias("x"), cy.alias("y"),
                          F.lit(1).cast("bigint").alias("label"))


def chance(*parts: Column | str, seed: int) -> Column:
    """0 <= value < 1 from 52 bits of an md5 of the parts and the seed."""
    key = F.md5(F.concat_ws("-", *(F.col(p) if isinstance(p, str) else p for p in parts), F.lit(seed)))
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / float(2**52)


def on_masks(points: DataFrame, runs: DataFrame) -> DataFrame:
    """Points (drawing_id, px, py whole) that lie on a pixel of any mask."""
    strips = in_strips(runs).selectExpr("drawing_id", "y py", "strip", "x_start", "x_end")
    return (points.withColumn("strip", F.floor(F.col("px") / STRIP))
            .join(large(strips), ["drawing_id", "py", "strip"])
            .where("px >= x_start AND px < x_end").select(points.columns).distinct())


def negative_points(symbols: DataFrame, pages: DataFrame, runs: DataFrame, count: int = 2,
                    seed: int = 42) -> DataFrame:
    """(drawing_id, symbol_id, place, x, y): points around each symbol on no mask.

    Candidates lie at 1.2 to 4 times the symbol's size in any direction. Symbols
    with too few of them get the first free points at the page's edges, and at
    last the point at a quarter of the page.
    """
    key = ["drawing_id", "symbol_id"]
    cx, cy = g.center(box())
    size = F.greatest(g.width(box()), g.height(box()))
    page = symbols.join(large(pages.select("drawing_id", "width", "height")), "drawing_id").select(
        *key, "width", "height", cx.alias("cx"), cy.alias("cy"), size.alias("size"))
    far = F.col("size") * (1.2 + 2.8 * chance(*key, "i", F.lit("d"), seed=seed))
    turn = 2 * F.pi() * chance(*key, "i", F.lit("a"), seed=seed)
    tried = (page.withColumn("i", _numbers(count * 20))
             .withColumns({"x": F.col("cx") + far * F.cos(turn), "y": F.col("cy") + far * F.sin(turn)})
             .where("x >= 0 AND x < width AND y >= 0 AND y < height")
             .select(*key, "i", F.col("x").cast("bigint").alias("px"), F.col("y").cast("bigint").alias("py")))
    spots = tried.select("drawing_id", "px", "py").distinct()
    free = tried.join(large(on_masks(spots, runs)), ["drawing_id", "px", "py"], "left_anti")
    per_symbol = Window.partitionBy(*key).orderBy("i")
    first = free.withColumn("place", F.row_number().over(per_symbol) - 1).where(F.col("place") < count)
    enough = first.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") >= count)
    good = first.join(large(enough.select(*key)), key, "left_semi").select(
        *key, "place", F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y"))

    # Shares of the page's width and height, in the order they are tried.
    edges = [("width*0.1D", "height*0.1D"), ("width*0.9D", "height*0.1D"), ("width*0.1D", "height*0.9D"),
             ("width*0.9D", "height*0.9D"), ("width*0.5D", "0D"), ("width*0.5D", "height-1D"),
             ("0D", "height*0.5D"), ("width-1D", "height*0.5D")]
    listed = F.expr("array(" + ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in edges) + ")")
    rim = pages.select("drawing_id", F.posexplode(listed).alias("i", "e")).select(
        "drawing_id", "i", "e.x", "e.y", F.col("e.x").cast("bigint").alias("px"), F.col("e.y").cast("bigint").alias("py"))
    taken = on_masks(rim.select("drawing_id", "px", "py"), runs)
    per_page = Window.partitionBy("drawing_id").orderBy("i")
    spare = (rim.join(large(taken), ["drawing_id", "px", "py"], "left_anti")
             .withColumn("place", F.row_number().over(per_page) - 1).where(F.col("place") < count)
             .select("drawing_id", "place", "x", "y"))
    lacking = (page.join(large(enough.select(*key)), key, "left_anti").withColumn("place", _numbers(count))
               .withColumn("place", F.col("place").cast("int")))
    filled = lacking.join(large(spare), ["drawing_id", "place"], "left").select(
        *key, "place", F.coalesce("x", F.floor(F.col("width") / 4).cast("double")).alias("x"),
        F.coalesce("y", F.floor(F.col("height") / 4).cast("double")).alias("y"))
    return good.unionByName(filled)


def count_on_masks(points: DataFrame, runs: DataFrame) -> DataFrame:
    """Points and those of them on a mask, per drawing."""
    whole = points.select("drawing_id", F.col("x").cast("bigint").alias("px"), F.col("y").cast("bigint").alias("py"))
    hit = on_masks(whole.distinct(), runs).withColumn("hit", F.lit(True))
    return (whole.join(large(hit), ["drawing_id", "px", "py"], "left").groupBy("drawing_id")
            .agg(F.count("*").alias("points"), F.count("hit").alias("on_mask")))


def _keyed(drawings: DataFrame, seed: int) -> DataFrame:
    key = F.md5(F.concat_ws("-", F.col("drawing_id").cast("string"), F.lit(seed)))
    return drawings.select("drawing_id").distinct().withColumn("_key", key)


def split(drawings: DataFrame, ratio: float = 0.9, seed: int = 42) -> DataFrame:
    """Whole drawings into train and val: the first int(n * ratio) in seeded order."""
    cut = drawings.agg((F.count_distinct("drawing_id") * ratio).cast("bigint")).scalar()
    placed = with_position(_keyed(drawings, seed), [], ["_key", "drawing_id"], "place")
    return placed.select(
        "drawing_id", F.when(F.col("place") < cut, "train").otherwise("val").alias("split"))


def sample(drawings: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """At most ``size`` drawings, the first ones in seeded order; each task passes on no more than these."""
    return _keyed(drawings, seed).orderBy("_key", "drawing_id").limit(size).select("drawing_id")

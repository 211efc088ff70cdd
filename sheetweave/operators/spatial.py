"""Distance joins: grid cells as equi-join keys, the exact test afterwards.

A pair is reported in one cell only, the lowest cell that both sides share, so
no second shuffle removes duplicates. Callers fold exact copies of a position
before the join, so a pile of copies costs one row per side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetweave.functions.geometry import Box, Segment, bounds, point_segment_distance
from sheetweave.operators.joining import large
from sheetweave.scratch import Scratch

KEY = ["drawing_id"]
#: Rows of one side of a join key that stay together.
BLOCK = 8192


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("bigint")


def with_cells(df: DataFrame, b: Box, size: float, reach=0) -> DataFrame:
    """One row per grid cell that the grown box covers; ``low_*`` is its first cell."""
    ends = [_cell(b.x1 - reach, size), _cell(b.x2 + reach, size),
            _cell(b.y1 - reach, size), _cell(b.y2 + reach, size)]
    out = df.withColumns({"low_x": ends[0], "_hx": F.greatest(ends[0], ends[1]),
                          "low_y": ends[2], "_hy": F.greatest(ends[2], ends[3])})
    out = out.withColumn("cell_x", F.explode(F.sequence("low_x", "_hx")))
    out = out.withColumn("cell_y", F.explode(F.sequence("low_y", "_hy")))
    return out.drop("_hx", "_hy")


def pair_join(left: DataFrame, right: DataFrame, left_box: Box, right_box: Box,
              size: float, reach=0, keys: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Pairs of rows whose boxes, the left one grown by the reach, share a cell.

    Apart from the keys the sides must not share column names. The result is a superset of all
    pairs within the reach, each pair once; filter it exactly. A box belongs to the grid whose cells are
    as large as itself, ``size`` or twice, four times, eight times that, and takes at most four cells
    there; it is also put into the larger grids that boxes of the other side belong to. A pair
    meets in the grid of the larger box, so neither page-size nor tiny boxes multiply rows, and a crowded
    cell holds boxes of which most overlap. Such cells are dealt out, see ``dealt``.
    """
    keys = keys or KEY
    scratch = Scratch(left.sparkSession)
    sides = [scratch.save(_levelled(left, left_box, size, reach, "_a")),
             scratch.save(_levelled(right, right_box, size, 0, "_b"))]
    # Grids double in size, so there are few of them whatever the table.
    found = sides[0].select("_al").distinct().withColumn("_side", F.lit(0)).unionByName(
        sides[1].select(F.col("_bl").alias("_al"), F.lit(1).alias("_side")).distinct()).collect()
    spread = []
    for side, (rows, p) in enumerate(zip(sides, ("_a", "_b"))):
        others = sorted({r["_al"] for r in found if r["_side"] != side})
        grids = F.filter(F.array_distinct(F.concat(F.array(f"{p}l"), F.array(*map(F.lit, others)) if others else F.array(f"{p}l"))),
                         lambda g: g >= F.col(f"{p}l"))
        placed = rows.withColumn("_grid", F.explode(grids))
        ends = {f"{p}{c}": F.floor(F.col(f"{p}{c}") / (size * F.pow(F.lit(2.0), "_grid"))).cast("bigint")
                for c in ("x1", "x2", "y1", "y2")}
        placed = placed.withColumns(ends)
        placed = placed.withColumn("cell_x", F.explode(F.sequence(f"{p}x1", F.greatest(f"{p}x1", f"{p}x2"))))
        spread.append(placed.withColumn("cell_y", F.explode(F.sequence(f"{p}y1", F.greatest(f"{p}y1", f"{p}y2"))))
                      .drop(f"{p}x2", f"{p}y2"))
    a, b, on = dealt(*spread, [*keys, "_grid", "cell_x", "cell_y"], block)
    return (a.join(large(b), on)
            .where((F.col("_grid") == F.greatest("_al", "_bl")) & (F.col("cell_x") == F.greatest("_ax1", "_bx1"))
                   & (F.col("cell_y") == F.greatest("_ay1", "_by1")))
            .drop(*on[len(keys):], "_al", "_bl", "_ax1", "_bx1", "_ay1", "_by1"))


def _levelled(df: DataFrame, b: Box, size: float, reach, p: str) -> DataFrame:
    """Adds the corners of the grown box and the number of its grid, named by ``p``."""
    x = [(b.x1 - reach).cast("double"), (b.x2 + reach).cast("double")]
    y = [(b.y1 - reach).cast("double"), (b.y2 + reach).cast("double")]
    longer = F.greatest(F.abs(x[1] - x[0]), F.abs(y[1] - y[0]), F.lit(size).cast("double"))
    return df.withColumns({f"{p}x1": x[0], f"{p}x2": x[1], f"{p}y1": y[0], f"{p}y2": y[1],
                           f"{p}l": F.ceil(F.log2(longer / size)).cast("int")})


def dealt(left: DataFrame, right: DataFrame, on: list[str], block: int = BLOCK) -> tuple[DataFrame, DataFrame, list[str]]:
    """The sides of a join, and its key, with crowded keys spread over tasks: where a side has more than
    ``block`` rows of a key, both are dealt into blocks of about that many, and every block of one side
    meets every block of the other, each pair of blocks under a key of its own."""
    count = lambda df, name: df.groupBy(*on).agg(F.count("*").alias(name))
    crowded = (count(left, "_n").where(F.col("_n") > block).withColumn("_m", F.lit(0).cast("bigint"))
               .unionByName(count(right, "_m").where(F.col("_m") > block).withColumn("_n", F.lit(0).cast("bigint")))
               .groupBy(*on).agg(F.max("_n").alias("_n"), F.max("_m").alias("_m")))
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / block), F.lit(1))
    crowded = Scratch(left.sparkSession).save(crowded.select(*on, blocks("_n").alias("_n"), blocks("_m").alias("_m")))
    if crowded.isEmpty():
        return left, right, on
    both = []
    for df, own, other in ((left, "_i", "_j"), (right, "_j", "_i")):
        n, m = ("_n", "_m") if own == "_i" else ("_m", "_n")
        mine = F.pmod(F.xxhash64(*df.columns), F.coalesce(n, F.lit(1)))
        met = df.join(crowded, on, "left")
        both.append(met.withColumns({own: mine, other: F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(m, F.lit(1)) - 1))})
                    .drop("_n", "_m"))
    return *both, [*on, "_i", "_j"]


def point_cells(df: DataFrame, px: Column, py: Column, size: float) -> DataFrame:
    """Every point lies in exactly one cell."""
    return df.withColumns({"cell_x": _cell(px, size), "cell_y": _cell(py, size)})


def segment_cells(df: DataFrame, s: Segment, size: float, reach: Column | float) -> DataFrame:
    """Cells that come within the reach of the segment, not all of its bounding box."""
    around = with_cells(df, bounds(s), size, reach)
    middle = ((F.col("cell_x") + 0.5) * size, (F.col("cell_y") + 0.5) * size)
    near = point_segment_distance(*middle, s) <= reach + size * 0.7072
    return around.where(near).drop("low_x", "low_y")

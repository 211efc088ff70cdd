"""Ink of a page as runs (drawing_id, y, x_start, x_end), and lines sampled on it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from sheetweave.operators.joining import large
from sheetweave.operators.masks import ROW, in_strips
from sheetweave.scratch import Scratch

LINE = ["drawing_id", "line_id"]
PLACE = ["x1", "y1", "x2", "y2"]
#: Side of the squares by which ink meets lines, lines of a square that stay together, and what a place from 0 to the side is packed by.
TILE, SHARE, WIDE = 256, 8192, 512
SQUARE = np.array([[TILE, TILE]])
#: Points that are worked on at once.
POINTS = 1 << 20


@dataclass(frozen=True)
class Sampling:
    """Evenly spaced points on lines: ``count`` of them, or one for each ``step`` pixels, and for each the
    points up to ``half`` whole steps along the normal, from the rounded-down point if ``whole``."""

    count: int | None = 80
    step: int = 1
    half: int = 0
    whole: bool = False

    @property
    def across(self) -> int:
        return 2 * self.half + 1

    def counts(self, lines: np.ndarray) -> np.ndarray:
        if self.count:
            return np.full(len(lines), self.count)
        return np.maximum(12, np.floor(np.maximum(1, np.floor(_lengths(lines))) / self.step)).astype(np.int64)

    def portions(self, lines: np.ndarray) -> list[tuple[int, int]]:
        """First row and end of runs of lines that have about ``POINTS`` points, or are one line."""
        total = np.cumsum(self.counts(lines) * self.across)
        starts = np.flatnonzero(np.diff(total // POINTS, prepend=-1))
        return list(zip(starts.tolist(), [*starts[1:].tolist(), len(lines)]))

    def points(self, lines: np.ndarray, square: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row of the line, place among its points (samples in order, each from -half to half), x and y.

        With a square (or one for each line), samples too far from it to have a point in it are left out.
        """
        n = self.counts(lines)
        ends = np.cumsum(n)
        row = np.repeat(np.arange(len(lines)), n)
        i = np.arange(len(row)) - np.repeat(ends - n, n)
        x1, y1, x2, y2 = lines.T
        sx, sy = (np.repeat(a, n) + i * np.repeat((b - a) / (n - 1), n) for a, b in ((x1, x2), (y1, y2)))
        sx[ends - 1], sy[ends - 1] = x2, y2
        if square is not None:
            margin = self.half + 2
            tx, ty = (np.repeat(np.broadcast_to(np.asarray(t) * TILE, len(lines)), n) for t in square)
            near = np.flatnonzero((sx >= tx - margin) & (sx <= tx + TILE + margin) & (sy >= ty - margin) & (sy <= ty + TILE + margin))
            row, i, sx, sy = row[near], i[near], sx[near], sy[near]
        if not self.half:
            return row, i, np.trunc(sx).astype(np.int64), np.trunc(sy).astype(np.int64)
        if self.whole:
            sx, sy = np.trunc(sx), np.trunc(sy)
        norm = _lengths(lines) + 1e-6
        offset = np.arange(-self.half, self.half + 1)
        px, py = (np.rint(s[:, None] + offset * d[row][:, None]).astype(np.int64)
                  for s, d in ((sx, (y1 - y2) / norm), (sy, (x2 - x1) / norm)))
        place = i[:, None] * self.across + np.arange(self.across)
        return np.repeat(row, self.across), place.ravel(), px.ravel(), py.ravel()


def _lengths(lines: np.ndarray) -> np.ndarray:
    x, y = lines[:, 2] - lines[:, 0], lines[:, 3] - lines[:, 1]
    return np.sqrt((x * x + y * y).astype(np.float64))


def _ints(*columns: pa.Array) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], 1)


def _inside(x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (x >= 0) & (x < size[:, 0]) & (y >= 0) & (y < size[:, 1])


def _squares(row: np.ndarray, tx: np.ndarray, ty: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different triples, in order. Neighbours on a line mostly share a square, so few are sorted."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (tx[1:] != tx[:-1]) | (ty[1:] != ty[:-1])
    row, tx, ty = row[new], tx[new], ty[new]
    order = np.lexsort((ty, tx, row))
    row, tx, ty = row[order], tx[order], ty[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (tx[1:] != tx[:-1]) | (ty[1:] != ty[:-1])
    return row[new], tx[new], ty[new]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values.astype(np.int32)))


def cut_ink(ink: DataFrame) -> DataFrame:
    """(drawing_id, tx, ty, run): runs cut at the edges of the squares of ``TILE`` pixels; row, start and end in one number."""
    low, high = F.floor(F.col("x_start") / TILE), F.floor((F.col("x_end") - 1) / TILE)
    cut = ink.where("x_end > x_start AND drawing_id IS NOT NULL").withColumn("tx", F.explode(F.sequence(low, high)))
    left = F.col("tx") * TILE
    run = (F.pmod("y", F.lit(TILE)) * WIDE * WIDE + F.greatest(F.col("x_start") - left, F.lit(0)) * WIDE
           + F.least(F.col("x_end") - left, F.lit(TILE)))
    return cut.select("drawing_id", "tx", F.floor(F.col("y") / TILE).alias("ty"), run.cast("int").alias("run"))


def _covered(runs: np.ndarray, square: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether runs of numbered squares cover places (square, row, column in one number)."""
    start = square * (TILE * TILE) + runs // (WIDE * WIDE) * TILE
    ends = np.sort(start + runs % WIDE)
    start = np.sort(start + runs // WIDE % WIDE)
    return np.searchsorted(start, at, "right") > np.searchsorted(ends, at, "right")


def _shared(crossed: DataFrame, cut: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Adds ``block`` to both: lines of a square that more than ``SHARE`` cross are dealt into blocks, each with all its ink."""
    square = ["drawing_id", "tx", "ty"]
    none = F.lit(0).cast("bigint")
    crowded = (crossed.groupBy(*square).agg(F.count("*").alias("n")).where(F.col("n") > SHARE)
               .select(*square, F.ceil(F.col("n") / SHARE).alias("n")))
    crowded = scratch.save(crowded)
    if crowded.isEmpty():
        return crossed.withColumn("block", none), cut.withColumn("block", none)
    n = F.coalesce("n", F.lit(1).cast("bigint"))
    return (crossed.join(crowded, square, "left").withColumn("block", F.pmod(F.xxhash64("line_id"), n)).drop("n"),
            cut.join(crowded, square, "left").withColumn("block", F.explode(F.sequence(none, n - 1))).drop("n"))


def probed(lines: DataFrame, ink: DataFrame, pages: DataFrame, sampling: Sampling) -> DataFrame:
    """Lines on a page, (drawing_id, line_id, x1 .. y2, width, height, hits), with the places of the points on ink.

    A line meets the few squares that its points lie in, not a row of ink per point. Ink and lines are
    sorted by square, and the squares of a batch are looked at together; ink of its last one is kept for the next batch.
    """
    placed = lines.select(*LINE, *PLACE).join(pages.select("drawing_id", "width", "height"), "drawing_id")
    drawing = lines.select("drawing_id").schema["drawing_id"]
    whole = StructType([drawing, *(StructField(c, LongType()) for c in ("tx", "ty", "line_id", *PLACE, "width", "height"))])

    def spread(batches):
        for batch in batches:
            every = _ints(*batch.columns[1:])
            for start, end in sampling.portions(every[:, 1:5]):
                numbers = every[start:end]
                row, _, x, y = sampling.points(numbers[:, 1:5])
                there = _inside(x, y, numbers[row, 5:7])
                met, tx, ty = _squares(row[there], x[there] // TILE, y[there] // TILE)
                rows = numbers[met]
                columns = [batch.column(0).take(pa.array(start + met)), pa.array(tx), pa.array(ty), *(pa.array(rows[:, c]) for c in range(7))]
                yield pa.RecordBatch.from_arrays(columns, names=whole.names)

    scratch = Scratch(lines.sparkSession)
    crossed = scratch.save(placed.select("drawing_id", "line_id", *PLACE, "width", "height").mapInArrow(spread, whole))
    crossed, cut = _shared(crossed, cut_ink(ink), scratch)
    square = ["drawing_id", "tx", "ty", "block"]
    numbers = F.array("line_id", *PLACE, "width", "height")
    rows = (cut.withColumn("piece", F.lit(None).cast("array<bigint>"))
            .unionByName(crossed.select(*square, F.lit(None).cast("int").alias("run"), numbers.alias("piece"))))
    met = rows.repartition(*square).sortWithinPartitions(*square, F.col("run").isNull())
    found = StructType([drawing, StructField("line_id", LongType()), StructField("hits", ArrayType(IntegerType()))])

    def look(batches):
        last, kept = None, np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            part = dict(zip(batch.schema.names, batch.columns))
            keys = np.stack([part["drawing_id"].dictionary_encode().indices.to_numpy(),
                             *(part[c].to_numpy() for c in ("tx", "ty", "block"))])
            number = np.append(0, np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            place = lambda n: tuple(part[c][n].as_py() for c in square)
            if place(0) != last:
                kept = kept[:0]
            line = part["run"].is_null().to_numpy(zero_copy_only=False)
            runs = np.append(kept, part["run"].drop_null().to_numpy().astype(np.int64))
            owner = np.append(np.zeros(len(kept), np.int64), number[~line])
            kept, last = np.unique(runs[owner == number[-1]]), place(batch.num_rows - 1)
            at = np.flatnonzero(line)
            every = part["piece"].flatten().to_numpy().reshape(-1, 7)
            for start, end in sampling.portions(every[:, 1:5]):
                lines, own = every[start:end], at[start:end]
                tx, ty = keys[1][own], keys[2][own]
                row, spot, x, y = sampling.points(lines[:, 1:5], (tx, ty))
                inner_x, inner_y = x - (tx * TILE)[row], y - (ty * TILE)[row]
                here = np.flatnonzero(_inside(inner_x, inner_y, SQUARE) & _inside(x, y, lines[row, 5:7]))
                wanted = number[own][row[here]] * (TILE * TILE) + inner_y[here] * TILE + inner_x[here]
                hit = here[_covered(runs, owner, wanted)]
                sizes = np.bincount(row[hit], minlength=len(lines))
                some = np.flatnonzero(sizes)
                yield pa.RecordBatch.from_arrays([part["drawing_id"].take(pa.array(own[some])), pa.array(lines[some, 0]),
                                                  _lists(spot[hit], sizes[some])], names=found.names)

    hits = (met.mapInArrow(look, found).groupBy(*LINE).agg(F.flatten(F.collect_list("hits")).alias("hits")))
    return placed.join(large(hits), LINE, "left").select(*LINE, *PLACE, "width", "height", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"))


def _measured(lines: DataFrame, ink: DataFrame, pages: DataFrame, sampling: Sampling,
              measure: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple], schema: dict) -> DataFrame:
    """Values of ``measure`` for many lines at once, from (samples, across) flags on the page and on ink and the line of each sample."""
    fields = [lines.schema["drawing_id"], lines.schema["line_id"], *(StructField(c, t) for c, t in schema.items())]

    def run(batches):
        for batch in batches:
            every = _ints(*batch.columns[2:8])
            for start, end in sampling.portions(every[:, :4]):
                numbers, part = every[start:end], batch.slice(start, end - start)
                row, _, x, y = sampling.points(numbers[:, :4])
                inside = _inside(x, y, numbers[row, 4:6])
                ends = np.cumsum(np.bincount(row, minlength=len(numbers)))
                hit = np.zeros(len(row), bool)
                sizes = part.column(8).value_lengths().to_numpy()
                owner = np.repeat(np.arange(len(numbers)), sizes)
                hit[np.append(0, ends)[owner] + part.column(8).flatten().to_numpy()] = True
                shape = (-1, sampling.across)
                found = measure(inside.reshape(shape), hit.reshape(shape), row[::sampling.across])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(c, to_arrow_type(t)) for c, t in zip(found, schema.values()))],
                    names=["drawing_id", "line_id", *schema])

    return probed(lines, ink, pages, sampling).mapInArrow(run, StructType(fields))


def _flips(flags: np.ndarray, row: np.ndarray, count: int) -> np.ndarray:
    """Changes from one flag of a line to its next, by line."""
    return np.bincount(row[1:][(flags[1:] != flags[:-1]) & (row[1:] == row[:-1])], minlength=count)


def _gaps(flags: np.ndarray, row: np.ndarray, count: int) -> np.ndarray:
    """Longest stretch without a flag, by line."""
    sizes = np.bincount(row, minlength=count)
    first = np.append(0, np.cumsum(sizes + 1))  # a mark before each line and one after the last
    marked = np.ones(first[-1] + 1, bool)
    marked[np.arange(len(row)) + row + 1] = flags
    marks = np.flatnonzero(marked)
    return np.maximum.reduceat(np.diff(marks) - 1, np.searchsorted(marks, first[:-1]))


def solid_stats(lines: DataFrame, ink: DataFrame, pages: DataFrame, count: int = 80) -> DataFrame:
    """Density of ink, longest gap and number of flips along each line.

    Lines with fewer than ten samples on the page get 0, 999 and 999.
    """
    def measure(inside, hit, row):
        lines, inside = row[-1] + 1, inside[:, 0]
        flags, row = hit[inside, 0], row[inside]
        n = np.bincount(row, minlength=lines)
        few = n < 10
        density = np.bincount(row, flags, minlength=lines) / np.maximum(n, 1)
        return np.where(few, 0.0, density), np.where(few, 999, _gaps(flags, row, lines)), np.where(few, 999, _flips(flags, row, lines))

    kinds = {"density": DoubleType(), "max_gap": LongType(), "transitions": LongType()}
    return _measured(lines, ink, pages, Sampling(count), measure, kinds)


def solid_lines(lines: DataFrame, ink: DataFrame, pages: DataFrame, min_density: float = 0.68,
                max_gap: int = 4, max_transitions: int = 6) -> DataFrame:
    """Lines that run on ink without larger gaps."""
    good = solid_stats(lines, ink, pages).where(
        (F.col("density") >= min_density) & (F.col("max_gap") <= max_gap)
        & (F.col("transitions") <= max_transitions))
    return lines.join(large(good.select(*LINE)), LINE, "left_semi")


def band_scores(lines: DataFrame, ink: DataFrame, pages: DataFrame, half: int = 2,
                count: int = 80) -> DataFrame:
    """Share of ink in a band around the line, and flips along its middle."""
    def measure(inside, hit, row):
        lines = row[-1] + 1
        on, there = (np.bincount(row, flags.sum(axis=1), minlength=lines) for flags in (hit, inside))
        return on / np.maximum(there, 1), _flips(hit[:, half], row, lines)

    return _measured(lines, ink, pages, Sampling(count, half=half), measure, {"fill": DoubleType(), "transitions": LongType()})


def sample_hits(lines: DataFrame, ink: DataFrame, pages: DataFrame, step: int = 1,
                half: int = 2) -> DataFrame:
    """One flag per sample: ink on any of the points across the line, as text of 0 and 1."""
    def measure(inside, hit, row):
        flags = (hit.any(axis=1) + np.uint8(48)).astype(np.uint8).tobytes().decode()
        ends = np.cumsum(np.bincount(row)).tolist()
        return ([flags[a:b] for a, b in zip([0, *ends], ends)],)

    return _measured(lines, ink, pages, Sampling(None, step, half, whole=True), measure, {"hits": StringType()})


def erase(ink: DataFrame, boxes: DataFrame, pad: int = 0) -> DataFrame:
    """Ink outside of the padded boxes, both edges of a box included.

    A run is cut into the pieces between the boxes over it. Per run only the
    furthest end of every box start matters, at most one per pixel of the page.
    """
    covers = boxes.select(
        "drawing_id", F.explode(F.sequence(F.col("y1") - pad, F.col("y2") + pad)).alias("y"),
        (F.col("x1") - pad).alias("x_start"), (F.col("x2") + pad + 1).alias("x_end"))
    covers = covers.groupBy("drawing_id", "y", "x_start").agg(F.max("x_end").alias("x_end"))
    shade = in_strips(covers).selectExpr(*ROW, "x_start c1", "x_end c2")
    run = ["drawing_id", "y", "x_start", "x_end"]
    ink = ink.select(*run).where("x_end > x_start").distinct()
    over = (in_strips(ink).join(large(shade), ROW).where("c1 < x_end AND x_start < c2")
            .groupBy(*run, "c1").agg(F.max("c2").alias("c2"))
            .groupBy(*run).agg(F.sort_array(F.collect_list(F.struct("c1", "c2"))).alias("covers")))
    cut = F.expr("""
        aggregate(covers,
          named_struct('at', x_start, 'left', CAST(array() AS ARRAY<STRUCT<a: BIGINT, b: BIGINT>>)),
          (s, c) -> named_struct(
            'at', greatest(s.at, c.c2),
            'left', IF(c.c1 > s.at, array_append(s.left, named_struct('a', s.at, 'b', c.c1)), s.left)),
          s -> IF(s.at < x_end, array_append(s.left, named_struct('a', s.at, 'b', x_end)), s.left))""")
    pieces = over.withColumn("piece", F.explode(cut)).selectExpr(
        "drawing_id", "y", "piece.a x_start", "piece.b x_end")
    return ink.join(large(over.select(*run)), run, "left_anti").unionByName(pieces)


def keep_area(ink: DataFrame, pages: DataFrame, frames: DataFrame, keep_ratio: float = 0.78) -> DataFrame:
    """Ink left of the notes block and inside the frame; no frame means the whole page.

    Pages are (drawing_id, width, height), frames (drawing_id, x1 .. y2).
    """
    area = pages.join(frames, "drawing_id", "left").select(
        "drawing_id", F.coalesce("x1", F.lit(0)).alias("f1"), F.coalesce("y1", F.lit(0)).alias("g1"),
        F.least((F.col("width") * keep_ratio).cast("bigint"), F.coalesce("x2", "width")).alias("f2"),
        F.coalesce("y2", "height").alias("g2"))
    return (ink.join(large(area), "drawing_id").where("y >= g1 AND y < g2")
            .selectExpr("drawing_id", "y", "greatest(x_start, f1) x_start", "least(x_end, f2) x_end")
            .where("x_end > x_start"))


def choose_frame(contours: DataFrame, pages: DataFrame, shrink: int = 28) -> DataFrame:
    """Best contour box of each page, shrunk: large, few corners, near the page edges.

    Contours are (drawing_id, contour_id, x, y, w, h, vertices).
    """
    near_edges = (F.expr("CAST(x < 0.08*width AS INT) + CAST(y < 0.08*height AS INT)"
                         " + CAST(x + w > 0.92*width AS INT) + CAST(y + h > 0.92*height AS INT)"))
    area = F.col("w") * F.col("h")
    score = (area + F.when(F.col("vertices") <= 8, 1.0).otherwise(0.0) * 0.25 * area
             + near_edges * 0.10 * area)
    best = (contours.join(pages, "drawing_id")
            .where(area >= 0.20 * F.col("width") * F.col("height"))
            .groupBy("drawing_id", "width", "height")
            .agg(F.max_by(F.struct("contour_id", "x", "y", "w", "h"),
                          F.struct(score, -F.col("contour_id"))).alias("c")))
    return best.select(
        "drawing_id", "c.contour_id", F.greatest(F.col("c.x") + shrink, F.lit(0)).alias("x1"),
        F.greatest(F.col("c.y") + shrink, F.lit(0)).alias("y1"),
        F.least(F.col("c.x") + F.col("c.w") - shrink, F.col("width")).alias("x2"),
        F.least(F.col("c.y") + F.col("c.h") - shrink, F.col("height")).alias("y2"))

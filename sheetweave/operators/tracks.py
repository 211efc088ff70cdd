"""Flat and upright segments joined along shared tracks, in one sorted sweep.

A segment joins the run before it when it starts 0 to ``gap`` pixels after the
run's end and lies at most ``track`` pixels off the run's first track. The end
of a run is always that of its last segment, so the gap only looks at the
neighbour in sorted order; gaps that fail cut the order into stretches. Within a
stretch only the distinct tracks, at most one per pixel of the page, are folded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetweave.functions import geometry as g
from sheetweave.functions.geometry import box
from sheetweave.operators.joining import large
from sheetweave.operators.ordering import with_position, with_successor, with_sum_before

RUN = ["drawing_id", "orientation"]


def snap(segments: DataFrame, angle: float = 5.5) -> DataFrame:
    """(drawing_id, line_id, orientation, track, low, high); others are left out."""
    s = box()
    tilt = F.abs(F.degrees(F.atan2((s.y2 - s.y1).cast("double"), (s.x2 - s.x1) + 1e-6)))
    flat = (tilt <= angle) | (F.abs(tilt - 180) <= angle)
    upright = F.abs(tilt - 90) <= angle
    pick = (lambda a, b: F.when(F.col("orientation") == "h", a).otherwise(b))
    return (segments.withColumn("orientation", F.when(flat, "h").when(upright, "v"))
            .where(F.col("orientation").isNotNull())
            .select("drawing_id", "line_id", "orientation",
                    F.bround(pick(s.y1 + s.y2, s.x1 + s.x2) / 2).cast("bigint").alias("track"),
                    pick(F.least(s.x1, s.x2), F.least(s.y1, s.y2)).alias("low"),
                    pick(F.greatest(s.x1, s.x2), F.greatest(s.y1, s.y2)).alias("high")))


def sweep_collinear(segments: DataFrame, gap: int = 7, angle: float = 5.5, track: int = 3,
                    min_length: int = 6) -> DataFrame:
    """Merged runs: (drawing_id, orientation, x1, y1, x2, y2)."""
    placed = with_position(snap(segments, angle), RUN, ["track", "low", "high", "line_id"])
    cut = with_successor(placed.select(*RUN, "position", "track", "low", "high"), RUN, "position", ["low"],
                         how="left")
    # A gap is a property of the later row: bring it there as the row after.
    space = F.col("next_low") - F.col("high")
    breaks = cut.select(*RUN, "position", "track", "low", "high",
                        F.when(space.between(0, gap), 0).otherwise(1).alias("cut"))
    stretches = with_sum_before(breaks, RUN, "position", "cut", "stretch")
    tracks = (stretches.select(*RUN, "stretch", "track").distinct().groupBy(*RUN, "stretch")
              .agg(F.sort_array(F.collect_list("track")).alias("tracks")))
    # The first track of a run holds for all tracks not too far from it.
    folded = F.expr(f"""
        aggregate(tracks, CAST(array() AS ARRAY<STRUCT<track: BIGINT, base: BIGINT>>),
          (runs, t) -> array_append(runs, named_struct('track', t, 'base',
            IF(size(runs) > 0 AND t - element_at(runs, -1).base <= {track}, element_at(runs, -1).base, t))))""")
    bases = tracks.select(*RUN, "stretch", F.explode(folded).alias("b")).select(
        *RUN, "stretch", "b.track", "b.base")
    runs = (stretches.join(large(bases), [*RUN, "stretch", "track"]).groupBy(*RUN, "stretch", "base")
            .agg(F.min("low").alias("low"), F.max("high").alias("high"))
            .where(F.col("high") - F.col("low") >= min_length))
    flat = F.col("orientation") == "h"
    pick = (lambda a, b: F.when(flat, F.col(a)).otherwise(F.col(b)))
    return runs.select(*RUN, pick("low", "base").alias("x1"), pick("base", "low").alias("y1"),
                       pick("high", "base").alias("x2"), pick("base", "high").alias("y2"))

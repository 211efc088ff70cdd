"""Look-ups between detections, labels, points, lines and assets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetweave.functions import geometry as g
from sheetweave.functions.geometry import box
from sheetweave.operators.joining import large
from sheetweave.operators.spatial import pair_join, point_cells, segment_cells, with_cells

PLACE = ["x1", "y1", "x2", "y2"]
CELL = ["drawing_id", "cell_x", "cell_y"]
MERGE_ANGLE, MERGE_GAP, MERGE_PERP = 5.0, 30.0, 20.0


def overlapping_pairs(boxes: DataFrame, id_column: str, threshold: float, size: float = 64) -> DataFrame:
    """(drawing_id, a, b, iou) with a < b for boxes of which the IoU exceeds the threshold."""
    def side(p):
        return boxes.select("drawing_id", F.col(id_column).alias(p),
                            *(F.col(c).alias(f"{p}_{c}") for c in PLACE))

    pairs = pair_join(side("a"), side("b"), box("a_"), box("b_"), size)
    return (pairs.where("a < b").withColumn("iou", g.iou(box("a_"), box("b_")))
            .where(F.col("iou") > threshold).select("drawing_id", "a", "b", "iou"))


def measured(lines: DataFrame, prefix: str = "") -> DataFrame:
    """Adds length, angle and direction of the segment, worked out once per row."""
    s = box(prefix)
    angle = F.col(f"{prefix}angle")
    return lines.withColumns({f"{prefix}len": g.segment_length(s), f"{prefix}angle": g.segment_angle(s)}) \
        .withColumns({f"{prefix}ux": F.cos(F.radians(angle)), f"{prefix}uy": F.sin(F.radians(angle))})


def _space_along(axis: str, other: str):
    """Gap of the two segments projected on the first one's axis; negative on overlap."""
    a, b, ux, uy = box(axis), box(other), F.col(f"{axis}ux"), F.col(f"{axis}uy")
    end, t1, t2 = (g.project(x, y, a.x1, a.y1, ux, uy)
                   for x, y in ((a.x2, a.y2), (b.x1, b.y1), (b.x2, b.y2)))
    return (F.greatest(F.least(F.lit(0.0), end), F.least(t1, t2))
            - F.least(F.greatest(F.lit(0.0), end), F.greatest(t1, t2)))


def _off_line(line: str, other: str):
    """Smaller distance of the other segment's ends from the infinite line."""
    a, b = box(line), box(other)
    vx, vy = a.x2 - a.x1, a.y2 - a.y1
    cross = F.least(*(F.abs(vx * (y - a.y1) - vy * (x - a.x1)) for x, y in ((b.x1, b.y1), (b.x2, b.y2))))
    return cross / (F.col(f"{line}len") + 1e-9)


def mergeable(a: str, b: str, angle: float = MERGE_ANGLE, gap: float = MERGE_GAP,
              perp: float = MERGE_PERP, slack: float = 0.0, either_axis: bool = False):
    """Nearly collinear measured segments that overlap along the first or nearly touch.

    Takes the prefixes of their columns; ``either_axis`` also looks along the second.
    """
    turn = g.angle_difference(F.col(f"{a}angle"), F.col(f"{b}angle"))
    off = F.least(_off_line(a, b), _off_line(b, a))
    close = _space_along(a, b) <= gap + slack
    if either_axis:
        close = close | (_space_along(b, a) <= gap + slack)
    return ((F.col(f"{a}len") >= 1) & (F.col(f"{b}len") >= 1) & (turn <= angle + slack)
            & (off <= perp + slack) & close)


def merge_reach(length, angle: float = MERGE_ANGLE, gap: float = MERGE_GAP, perp: float = MERGE_PERP):
    """How far a segment's box must grow to meet that of every mergeable one.

    Mergeable segments are at most gap + perp + length * tan(angle) apart, the
    length being the longer one's; each side takes half of the constant part.
    """
    slope = F.tan(F.radians(F.lit(angle)))
    return (gap + 1.2 * perp + 5.0) / 2 + length * slope


def collinear_pairs(lines: DataFrame, size: float = 128) -> DataFrame:
    """(drawing_id, a, b), a before b, for segments that would be merged."""
    def side(p):
        s = box(f"{p}_")
        named = lines.select("drawing_id", F.col("line_id").alias(p),
                             *(F.col(c).alias(f"{p}_{c}") for c in PLACE))
        grown = g.grow(g.bounds(s), merge_reach(F.col(f"{p}_len")))
        return measured(named, f"{p}_").withColumns({f"{p}_b{c}": v for c, v in zip(PLACE, grown)})

    pairs = pair_join(side("a"), side("b"), box("a_b"), box("b_b"), size)
    return (pairs.where("a < b").where(mergeable("a_", "b_"))
            .select("drawing_id", "a", "b"))


def topmost_box(points: DataFrame, boxes: DataFrame, id_column: str, size: float = 128) -> DataFrame:
    """Highest id among the boxes that hold a point, edges included."""
    spread = with_cells(boxes.select("drawing_id", F.col(id_column).alias("picked"), *PLACE), box(), size)
    placed = point_cells(points, F.col("px"), F.col("py"), size)
    return (placed.join(large(spread), CELL)
            .where(F.col("px").between(F.col("x1"), F.col("x2")) & F.col("py").between(F.col("y1"), F.col("y2")))
            .groupBy("drawing_id", "point_id").agg(F.max("picked").alias("picked")))


def topmost_mask(points: DataFrame, runs: DataFrame) -> DataFrame:
    """Highest id among the masks that hold a whole pixel."""
    strips = runs.where("x_end > x_start").select(
        "drawing_id", "mask_id", "y", "x_start", "x_end",
        F.explode(F.expr("sequence(floor(x_start/64), floor((x_end-1)/64))")).alias("strip"))
    placed = points.selectExpr("drawing_id", "point_id", "px", "py y", "floor(px/64) strip")
    return (placed.join(large(strips), ["drawing_id", "y", "strip"])
            .where("px >= x_start AND px < x_end")
            .groupBy("drawing_id", "point_id").agg(F.max("mask_id").alias("picked")))


def nearest_line(points: DataFrame, lines: DataFrame, closer_than: float = 5.0,
                 visible: tuple[str, ...] = ("solid", "dashed"), size: float = 32) -> DataFrame:
    """The line nearest to a point, solid before dashed and low before high ids on ties."""
    shown = lines.where(F.col("line_type").isin(*visible)).select(
        "drawing_id", "line_id", "line_type", *PLACE)
    pieces = segment_cells(shown, box(), size, closer_than)
    placed = point_cells(points, F.col("px"), F.col("py"), size)
    rank = F.when(F.col("line_type") == "solid", 0).otherwise(1)
    order = F.struct("distance", rank, "line_id")
    return (placed.join(large(pieces), CELL)
            .withColumn("distance", g.point_segment_distance(F.col("px"), F.col("py"), box()))
            .where(F.col("distance") < closer_than)
            .groupBy("drawing_id", "point_id")
            .agg(F.min_by(F.struct("line_id", "line_type", "distance"), order).alias("best"))
            .select("drawing_id", "point_id", "best.*"))


def map_labels(symbols: DataFrame, labels: DataFrame) -> DataFrame:
    """Category of the cluster, 'unlabeled' without one. Labels are (cluster_id, label)."""
    return (symbols.join(labels, "cluster_id", "left")
            .withColumn("category", F.coalesce("label", F.lit("unlabeled"))).drop("label"))


def reload_labels(symbols: DataFrame, saved: DataFrame) -> DataFrame:
    """Clusters of a saved classification by mask id; symbols not in it get cluster 0.

    Of several categories of one cluster the last in the file holds. Saved is
    (drawing_id, pos, mask_id, cluster_id, category).
    """
    known = saved.where("mask_id IS NOT NULL AND cluster_id IS NOT NULL").withColumn(
        "category", F.coalesce("category", F.lit("unknown")))
    of_mask = known.groupBy("drawing_id", "mask_id").agg(F.max_by("cluster_id", "pos").alias("cluster_id"))
    names = known.groupBy("drawing_id", "cluster_id").agg(F.max_by("category", "pos").alias("category"))
    return (symbols.join(large(of_mask), ["drawing_id", "mask_id"], "left")
            .withColumn("cluster_id", F.coalesce("cluster_id", F.lit(0).cast("bigint")))
            .join(large(names), ["drawing_id", "cluster_id"], "left")
            .withColumn("category", F.coalesce("category", F.lit("unlabeled"))))


def with_assets(drawings: DataFrame, images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Drawings that have both an image and annotations."""
    return (drawings.join(images, "drawing_id", "left_semi")
            .join(annotations, "drawing_id", "left_semi"))


def without_assets(drawings: DataFrame, images: DataFrame, annotations: DataFrame) -> DataFrame:
    return drawings.join(with_assets(drawings, images, annotations), "drawing_id", "left_anti")

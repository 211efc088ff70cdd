"""Geometry of boxes, points and segments as Column expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


Segment = Box


def box(prefix: str = "") -> Box:
    """The four coordinate columns of a row, e.g. ``box("t_")`` for t_x1 .. t_y2."""
    return Box(*(F.col(f"{prefix}{name}") for name in ("x1", "y1", "x2", "y2")))


def _at_least(value: Column, low: float) -> Column:
    return F.greatest(value, F.lit(low))


def _clip(value: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low, F.least(high, value))


# --- one box -----------------------------------------------------------------


def center(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2


def width(b: Box) -> Column:
    return b.x2 - b.x1


def height(b: Box) -> Column:
    return b.y2 - b.y1


def area(b: Box) -> Column:
    return width(b) * height(b)


def clamped_area(b: Box) -> Column:
    return _at_least(width(b), 0) * _at_least(height(b), 0)


def aspect(b: Box) -> Column:
    return width(b) / _at_least(height(b), 1)


def symmetric_aspect(b: Box) -> Column:
    w, h = width(b), height(b)
    return F.greatest(w, h) / _at_least(F.least(w, h), 1)


def grow(b: Box, pad) -> Box:
    return Box(b.x1 - pad, b.y1 - pad, b.x2 + pad, b.y2 + pad)


def quad_bounds(quad: Column) -> Box:
    """Bounding box of an array of [x, y] corners, truncated to whole pixels."""
    xs = F.transform(quad, lambda p: p[0])
    ys = F.transform(quad, lambda p: p[1])
    return Box(*(c.cast("bigint") for c in (F.array_min(xs), F.array_min(ys),
                                            F.array_max(xs), F.array_max(ys))))


def rescale_to_page(b: Box, x0, y0, scale, page_w, page_h) -> Box:
    """Tile coordinates to page coordinates, half-even rounded and clamped."""

    def place(value, origin, size):
        return _clip(F.bround((value + origin) / scale).cast("bigint"), 0, size - 1)

    return Box(place(b.x1, x0, page_w), place(b.y1, y0, page_h),
               place(b.x2, x0, page_w), place(b.y2, y0, page_h))


def unscale(s: Segment, inv_scale, inv_cap) -> Segment:
    """Segment of a down-sized image back to page pixels, half-even rounded."""
    return Segment(*(F.bround(v * inv_scale * inv_cap).cast("bigint") for v in s))


def resize_meta(page_w: Column, page_h: Column, target: Column) -> tuple[Column, Column]:
    """(scale, new height) of a page brought to the target width."""
    same = page_w == target
    scale = F.when(same, F.lit(1.0)).otherwise(target / page_w)
    new_h = F.when(same, page_h).otherwise(F.bround(page_h * scale).cast("bigint"))
    return scale, new_h


def unrotate90(b: Box, page_w) -> Box:
    """Box found on a page turned by 90 degrees, mapped back: (x, y) -> (y, W - x)."""
    return Box(F.least(b.y1, b.y2), F.least(page_w - b.x1, page_w - b.x2),
               F.greatest(b.y1, b.y2), F.greatest(page_w - b.x1, page_w - b.x2))


def pad_patch(b: Box, pad: int, page_w, page_h, from_mask: bool = False) -> Box:
    """Padded and clamped patch; masks hold inclusive maxima, hence one pixel more."""
    extra = pad + 1 if from_mask else pad
    return Box(_at_least(b.x1 - pad, 0), _at_least(b.y1 - pad, 0),
               F.least(page_w, b.x2 + extra), F.least(page_h, b.y2 + extra))


def clamp_box(b: Box, page_w, page_h) -> Box:
    """Box inside the page with sides of at least one pixel."""
    x1 = _clip(b.x1, 0, page_w - 1)
    y1 = _clip(b.y1, 0, page_h - 1)
    return Box(x1, y1, F.greatest(x1 + 1, F.least(b.x2, page_w)),
               F.greatest(y1 + 1, F.least(b.y2, page_h)))


def normalised_center_size(b: Box, page_w, page_h) -> tuple[Column, ...]:
    """(cx, cy, w, h) relative to the page, each within 0..1."""
    cx, cy = center(b)
    return tuple(_clip(v.cast("double"), 0.0, 1.0)
                 for v in (cx / page_w, cy / page_h, width(b) / page_w, height(b) / page_h))


# --- points and segments -----------------------------------------------------


def point_distance(ax, ay, bx, by) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def point_box_distance(px: Column, py: Column, b: Box) -> Column:
    """Distance to the closest point of the box, 0 inside."""
    dx = px - F.greatest(b.x1, F.least(px, b.x2))
    dy = py - F.greatest(b.y1, F.least(py, b.y2))
    return F.sqrt(dx * dx + dy * dy)


def segment_parameter(px: Column, py: Column, s: Segment) -> Column:
    """Position 0..1 of the closest point on the segment; 0 when it has no length."""
    dx, dy = s.x2 - s.x1, s.y2 - s.y1
    l2 = dx * dx + dy * dy
    t = ((px - s.x1) * dx + (py - s.y1) * dy) / F.nullif(l2, F.lit(0)).cast("double")
    return F.coalesce(_clip(t, 0.0, 1.0), F.lit(0.0))


def point_segment_distance(px: Column, py: Column, s: Segment) -> Column:
    t = segment_parameter(px, py, s)
    return point_distance(px, py, s.x1 + t * (s.x2 - s.x1), s.y1 + t * (s.y2 - s.y1))


def point_line_distance(px: Column, py: Column, s: Segment) -> Column:
    """Perpendicular distance to the infinite line through the segment."""
    vx, vy = s.x2 - s.x1, s.y2 - s.y1
    return F.abs(vx * (py - s.y1) - vy * (px - s.x1)) / (F.hypot(vx, vy) + 1e-9)


def segment_length(s: Segment) -> Column:
    dx, dy = s.x2 - s.x1, s.y2 - s.y1
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def segment_angle(s: Segment) -> Column:
    return F.degrees(F.atan2((s.y2 - s.y1).cast("double"), (s.x2 - s.x1).cast("double")))


def angle_difference(a: Column, b: Column) -> Column:
    """Undirected difference 0..90 of two angles in degrees."""
    d = F.abs(a - b) % 360.0
    d = F.least(d, 360.0 - d)
    return F.least(d, F.abs(d - 180.0))


def folded_angle_difference(a: Column, b: Column) -> Column:
    """The same by folding both angles to 0..180 first."""
    d = F.abs(F.pmod(a, F.lit(180.0)) - F.pmod(b, F.lit(180.0)))
    return F.when(d > 90, 180 - d).otherwise(d)


def unit_direction(angle: Column) -> tuple[Column, Column]:
    return F.cos(F.radians(angle)), F.sin(F.radians(angle))


def project(px, py, ox, oy, ux, uy) -> Column:
    return (px - ox) * ux + (py - oy) * uy


def cover_share(s: Segment, b: Box, step: int = 4) -> Column:
    """Share of evenly spaced samples of the segment that lie inside the box."""
    length = segment_length(s)
    n = F.greatest(F.lit(5), F.floor(length / step)).cast("int")

    def inside(i):
        t = i / n
        px, py = s.x1 + t * (s.x2 - s.x1), s.y1 + t * (s.y2 - s.y1)
        return px.between(b.x1, b.x2) & py.between(b.y1, b.y2)

    hits = F.size(F.filter(F.sequence(F.lit(0), n), inside))
    return F.when(length < 1e-6, F.lit(0.0)).otherwise(hits / (n + 1))


def confidence(distance: Column, max_distance: float) -> Column:
    return _at_least(1 - distance / max_distance, 0.0)


# --- two boxes ---------------------------------------------------------------


def union_box(a: Box, b: Box) -> Box:
    return Box(F.least(a.x1, b.x1), F.least(a.y1, b.y1),
               F.greatest(a.x2, b.x2), F.greatest(a.y2, b.y2))


def intersection_area(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return _at_least(w, 0) * _at_least(h, 0)


def boxes_touch(a: Box, b: Box) -> Column:
    return ((a.x1 <= b.x2) & (b.x1 <= a.x2) & (a.y1 <= b.y2) & (b.y1 <= a.y2))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, clamped areas, union of at least 1e-6."""
    inter = intersection_area(a, b)
    union = clamped_area(a) + clamped_area(b) - inter
    return F.when(inter <= 0, F.lit(0.0)).otherwise(inter / _at_least(union, 1e-6))


def iou_plain(a: Box, b: Box) -> Column:
    """Intersection over union, signed areas, union plus 1e-9."""
    inter = intersection_area(a, b)
    return F.when(inter <= 0, F.lit(0.0)).otherwise(
        inter / (area(a) + area(b) - inter + 1e-9))


def box_gap(a: Box, b: Box) -> Column:
    """Shortest distance between two boxes, 0 when they touch or overlap."""
    dx = F.greatest(F.lit(0), b.x1 - a.x2, a.x1 - b.x2)
    dy = F.greatest(F.lit(0), b.y1 - a.y2, a.y1 - b.y2)
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def alignment(a: Box, b: Box) -> Column:
    """0..1: how well two boxes stand in one row or column."""
    (acx, acy), (bcx, bcy) = center(a), center(b)
    dx, dy = F.abs(acx - bcx), F.abs(acy - bcy)
    mean_w = _at_least((width(a) + width(b)) / 2, 1)
    mean_h = _at_least((height(a) + height(b)) / 2, 1)
    in_row = F.when(dx > 0, 1 - F.least(dy / mean_h, F.lit(1.0))).otherwise(F.lit(1.0))
    in_column = F.when(dy > 0, 1 - F.least(dx / mean_w, F.lit(1.0))).otherwise(F.lit(1.0))
    score = F.greatest(in_row, in_column)
    shares_x = (a.x2 >= b.x1) & (b.x2 >= a.x1)
    shares_y = (a.y2 >= b.y1) & (b.y2 >= a.y1)
    return (F.when(shares_x | shares_y, F.least(score * 1.2, F.lit(1.0)))
            .otherwise(score * 0.8))


def containment(a: Box, b: Box, expansion=0) -> Column:
    """Share of box a that lies inside box b grown by the expansion."""
    inter = intersection_area(a, grow(b, expansion))
    return inter / _at_least(area(a), 1)


def x_overlap(a: Box, b: Box) -> Column:
    inter = _at_least(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), 0)
    return inter / _at_least(F.least(width(a), width(b)), 1)


def y_overlap(a: Box, b: Box) -> Column:
    inter = _at_least(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), 0)
    return inter / _at_least(F.least(height(a), height(b)), 1)


def same_line(a: Box, b: Box, share: float = 0.55) -> Column:
    return y_overlap(a, b) >= share


def stacked(a: Box, b: Box, share: float = 0.55) -> Column:
    return x_overlap(a, b) >= share


def bounds(s: Segment) -> Box:
    """Bounding box of a segment."""
    return Box(F.least(s.x1, s.x2), F.least(s.y1, s.y2),
               F.greatest(s.x1, s.x2), F.greatest(s.y1, s.y2))

"""Geometry scalars over symbols, texts, lines and neighbouring boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetweave.functions import geometry as g
from sheetweave.functions.geometry import box
from sheetweave.operators import graph
from sheetweave.plans.catalog.registry import box_columns, named, query, r6


def _pairs(fx):
    """Each detection with the next one of its drawing."""
    a = fx.detections.selectExpr("drawing_id", "det_id", "x1 a_x1", "y1 a_y1", "x2 a_x2", "y2 a_y2")
    b = fx.detections.selectExpr("drawing_id", "det_id-1 det_id",
                                 "x1 b_x1", "y1 b_y1", "x2 b_x2", "y2 b_y2")
    return a.join(b, ["drawing_id", "det_id"])


PAIRS = """
WITH pairs AS (SELECT a.drawing_id, a.det_id, a.x1 ax1, a.y1 ay1, a.x2 ax2, a.y2 ay2,
  b.x1 bx1, b.y1 by1, b.x2 bx2, b.y2 by2 FROM dets_v a JOIN dets_v b
  ON a.drawing_id = b.drawing_id AND b.det_id = a.det_id + 1),
measured AS (SELECT *,
  greatest(0, least(ax2,bx2)-greatest(ax1,bx1))*greatest(0, least(ay2,by2)-greatest(ay1,by1)) inter,
  (ax2-ax1)*(ay2-ay1) a_area, (bx2-bx1)*(by2-by1) b_area FROM pairs)
"""


def _symbol_line(fx):
    """Each line with the centre of the symbol of the same number."""
    s = fx.symbols.select("drawing_id", F.col("symbol_id").alias("line_id"),
                          ((F.col("x1") + F.col("x2")) / 2).alias("px"),
                          ((F.col("y1") + F.col("y2")) / 2).alias("py"))
    return fx.lines.join(s, ["drawing_id", "line_id"])


SYMBOL_LINE = """
WITH sl AS (SELECT l.*, (s.x1+s.x2)/2.0 px, (s.y1+s.y2)/2.0 py
  FROM lines_v l JOIN symbols_v s ON l.drawing_id = s.drawing_id AND l.line_id = s.symbol_id)
"""


@query("geo_center", """
SELECT drawing_id, symbol_id, (x1+x2)/2.0 cx, (y1+y2)/2.0 cy FROM symbols_v""")
def _(fx):
    cx, cy = g.center(box())
    return fx.symbols.select("drawing_id", "symbol_id", *named(cx=cx, cy=cy))


@query("geo_dims", """
SELECT drawing_id, symbol_id, x2-x1 w, y2-y1 h, (x2-x1)*(y2-y1) area,
  greatest(0, x2-x1-30)*greatest(0, y2-y1-30) inner_area FROM symbols_v""")
def _(fx):
    b = box()
    inner = g.clamped_area(g.grow(b, -15))
    return fx.symbols.select("drawing_id", "symbol_id", *named(
        w=g.width(b), h=g.height(b), area=g.area(b), inner_area=inner.cast("bigint")))


@query("geo_aspect", """
SELECT drawing_id, symbol_id, round((x2-x1)/greatest(y2-y1, 1), 6) aspect,
  round(greatest(x2-x1, y2-y1)/greatest(least(x2-x1, y2-y1), 1), 6) symmetric_aspect FROM symbols_v""")
def _(fx):
    return fx.symbols.select("drawing_id", "symbol_id", *named(
        aspect=r6(g.aspect(box())), symmetric_aspect=r6(g.symmetric_aspect(box()))))


@query("geo_quad_bbox", """
SELECT drawing_id, text_id, CAST(trunc(x1+0.25) AS BIGINT) x1, CAST(trunc(y1-0.5) AS BIGINT) y1,
  CAST(trunc(x2+0.75) AS BIGINT) x2, CAST(trunc(y2+0.5) AS BIGINT) y2 FROM texts_v""")
def _(fx):
    # A slightly skewed quadrilateral around every text.
    quad = F.expr("array(array(x1+0.25D, y1+0.0D), array(x2+0.5D, y1-0.5D),"
                  " array(x2+0.75D, y2+0.25D), array(x1+0.5D, y2+0.5D))")
    return fx.texts.select("drawing_id", "text_id", *box_columns(g.quad_bounds(quad)))


@query("geo_rescale", """
WITH placed AS (SELECT t.drawing_id, text_id, width w, height h,
  CAST(round_even((x1+37)/1.25, 0) AS BIGINT) x1, CAST(round_even((y1+11)/1.25, 0) AS BIGINT) y1,
  CAST(round_even((x2+37)/1.25, 0) AS BIGINT) x2, CAST(round_even((y2+11)/1.25, 0) AS BIGINT) y2
  FROM texts_v t JOIN drawings_v d ON t.drawing_id = d.drawing_id),
clamped AS (SELECT drawing_id, text_id, greatest(0, least(w-1, x1)) x1, greatest(0, least(h-1, y1)) y1,
  greatest(0, least(w-1, x2)) x2, greatest(0, least(h-1, y2)) y2 FROM placed)
SELECT * FROM clamped WHERE x2-x1 >= 3 AND y2-y1 >= 3""")
def _(fx):
    moved = g.rescale_to_page(box(), F.lit(37), F.lit(11), F.lit(1.25),
                              F.col("width"), F.col("height"))
    return (fx.texts.join(fx.drawings, "drawing_id")
            .select("drawing_id", "text_id", *box_columns(moved))
            .where((g.width(box()) >= 3) & (g.height(box()) >= 3)))


@query("geo_scale_symbols", """
WITH first_lines AS (SELECT * FROM lines_v QUALIFY row_number() OVER (PARTITION BY drawing_id ORDER BY line_id) <= 10),
la AS (SELECT drawing_id, avg((x1*5+y1*5+x2*5+y2*5)/4.0) line_avg FROM first_lines GROUP BY drawing_id),
sa AS (SELECT drawing_id, avg((x1+y1+x2+y2)/4.0) symbol_avg FROM symbols_v GROUP BY drawing_id),
f AS (SELECT sa.drawing_id, coalesce(line_avg, 3500) > 2*symbol_avg scaled FROM sa LEFT JOIN la USING (drawing_id)),
q AS (SELECT s.*, scaled, CASE WHEN scaled THEN 5.12 ELSE 1 END k FROM symbols_v s JOIN f USING (drawing_id))
SELECT drawing_id, symbol_id, CAST(trunc(x1*k) AS BIGINT) x1, CAST(trunc(y1*k) AS BIGINT) y1,
 CAST(trunc(x2*k) AS BIGINT) x2, CAST(trunc(y2*k) AS BIGINT) y2, scaled bbox_scaled FROM q""")
def _(fx):
    lines = fx.lines.selectExpr("drawing_id", "line_id", "x1*5 x1", "y1*5 y1", "x2*5 x2", "y2*5 y2")
    header = fx.drawings.selectExpr("drawing_id", "5.12D scale",
                                    "CAST(NULL AS BIGINT) resized_width")
    return (graph.scale_symbols(fx.symbols, lines, header)
            .select("drawing_id", "symbol_id", "x1", "y1", "x2", "y2", "bbox_scaled"))


@query("geo_resize_meta", """
SELECT drawing_id, round(CASE WHEN width = target_width THEN 1.0 ELSE target_width/width END, 6) scale,
  CASE WHEN width = target_width THEN height
    ELSE CAST(round_even(height*(target_width/width), 0) AS BIGINT) END new_h FROM drawings_v""")
def _(fx):
    scale, new_h = g.resize_meta(F.col("width"), F.col("height"), F.col("target_width"))
    return fx.drawings.select("drawing_id", *named(scale=r6(scale), new_h=new_h))


@query("geo_unrotate90", """
SELECT t.drawing_id, text_id, y1 x1, width-x2 y1, y2 x2, width-x1 y2
FROM texts_v t JOIN drawings_v d ON t.drawing_id = d.drawing_id""")
def _(fx):
    return (fx.texts.join(fx.drawings, "drawing_id")
            .select("drawing_id", "text_id", *box_columns(g.unrotate90(box(), F.col("width")))))


@query("geo_pad_patch", """
WITH p AS (SELECT s.drawing_id, symbol_id, false from_mask, greatest(0, x1-5) px1, greatest(0, y1-5) py1,
  least(width, x2+5) px2, least(height, y2+5) py2, x1, y1, x2, y2
  FROM symbols_v s JOIN drawings_v d ON s.drawing_id = d.drawing_id
 UNION ALL SELECT s.drawing_id, symbol_id, true, greatest(0, x1-5), greatest(0, y1-5),
  least(width, x2-1+6), least(height, y2-1+6), x1, y1, x2, y2
  FROM symbols_v s JOIN drawings_v d ON s.drawing_id = d.drawing_id)
SELECT drawing_id, symbol_id, from_mask, px1, py1, px2, py2, px2-px1 w, py2-py1 h, (x2-x1)*(y2-y1) area
FROM p WHERE px2-px1 >= 5 AND py2-py1 >= 5""")
def _(fx):
    placed = fx.symbols.join(fx.drawings, "drawing_id")
    page = (F.col("width"), F.col("height"))
    b = box()
    inclusive = g.Box(b.x1, b.y1, b.x2 - 1, b.y2 - 1)

    def patches(padded, from_mask):
        return placed.select("drawing_id", "symbol_id", F.lit(from_mask).alias("from_mask"),
                             *(c.alias(n) for c, n in zip(padded, ("px1", "py1", "px2", "py2"))),
                             g.width(padded).alias("w"), g.height(padded).alias("h"),
                             g.area(b).alias("area"))

    both = patches(g.pad_patch(b, 5, *page), False).unionByName(
        patches(g.pad_patch(inclusive, 5, *page, from_mask=True), True))
    return both.where("w >= 5 AND h >= 5")


@query("geo_clamp_box", """
WITH c AS (SELECT s.drawing_id, symbol_id, greatest(0, least(x1, width-401)) x1,
  greatest(0, least(y1, height-401)) y1, x2, y2, width-400 w, height-400 h
  FROM symbols_v s JOIN drawings_v d ON s.drawing_id = d.drawing_id)
SELECT drawing_id, symbol_id, x1, y1, greatest(x1+1, least(x2, w)) x2, greatest(y1+1, least(y2, h)) y2 FROM c""")
def _(fx):
    clamped = g.clamp_box(box(), F.col("width") - 400, F.col("height") - 400)
    return (fx.symbols.join(fx.drawings, "drawing_id")
            .select("drawing_id", "symbol_id", *box_columns(clamped)))


@query("geo_yolo_norm", """
SELECT s.drawing_id, symbol_id, round(greatest(0.0, least(1.0, ((x1+x2)/2.0)/width)), 6) cx,
  round(greatest(0.0, least(1.0, ((y1+y2)/2.0)/height)), 6) cy,
  round(greatest(0.0, least(1.0, (x2-x1)/width)), 6) w, round(greatest(0.0, least(1.0, (y2-y1)/height)), 6) h
FROM symbols_v s JOIN drawings_v d ON s.drawing_id = d.drawing_id""")
def _(fx):
    parts = g.normalised_center_size(box(), F.col("width"), F.col("height"))
    return (fx.symbols.join(fx.drawings, "drawing_id")
            .select("drawing_id", "symbol_id",
                    *(r6(p).alias(n) for p, n in zip(parts, ("cx", "cy", "w", "h")))))


@query("geo_pt_box_dist", """
WITH st AS (SELECT t.*, (s.x1+s.x2)/2.0 px, (s.y1+s.y2)/2.0 py FROM texts_v t JOIN symbols_v s
  ON t.drawing_id = s.drawing_id AND t.text_id = s.symbol_id)
SELECT drawing_id, text_id, round(sqrt(power(px-greatest(x1, least(px, x2)), 2)
  + power(py-greatest(y1, least(py, y2)), 2)), 6) dist FROM st""")
def _(fx):
    s = fx.symbols.select("drawing_id", F.col("symbol_id").alias("text_id"),
                          *(c.alias(n) for c, n in zip(g.center(box()), ("px", "py"))))
    return (fx.texts.join(s, ["drawing_id", "text_id"])
            .select("drawing_id", "text_id",
                    r6(g.point_box_distance(F.col("px"), F.col("py"), box())).alias("dist")))


SEG_T = SYMBOL_LINE + """, st AS (SELECT *, coalesce(greatest(0.0, least(1.0,
  ((px-x1)*(x2-x1)+(py-y1)*(y2-y1))/nullif((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1), 0))), 0) t FROM sl)
"""


@query("geo_pt_seg_dist", SEG_T + """
SELECT drawing_id, line_id, round(sqrt(power(px-(x1+t*(x2-x1)), 2)+power(py-(y1+t*(y2-y1)), 2)), 6) dist FROM st""")
def _(fx):
    return _symbol_line(fx).select("drawing_id", "line_id", r6(
        g.point_segment_distance(F.col("px"), F.col("py"), box())).alias("dist"))


@query("geo_pt_line_perp", SYMBOL_LINE + """
SELECT drawing_id, line_id, round(abs((x2-x1)*(py-y1)-(y2-y1)*(px-x1))
  /(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))+1e-9), 6) dist FROM sl""")
def _(fx):
    return _symbol_line(fx).select("drawing_id", "line_id", r6(
        g.point_line_distance(F.col("px"), F.col("py"), box())).alias("dist"))


@query("geo_seg_len", """
SELECT drawing_id, line_id, round(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)), 6) len FROM lines_v""")
def _(fx):
    return fx.lines.select("drawing_id", "line_id", r6(g.segment_length(box())).alias("len"))


@query("geo_pt_dist", SYMBOL_LINE + """
SELECT drawing_id, line_id, round(sqrt(power(px-x1, 2)+power(py-y1, 2)), 6) to_start,
  round(sqrt(power(px-x2, 2)+power(py-y2, 2)), 6) to_end FROM sl""")
def _(fx):
    p, s = (F.col("px"), F.col("py")), box()
    return _symbol_line(fx).select("drawing_id", "line_id", *named(
        to_start=r6(g.point_distance(*p, s.x1, s.y1)), to_end=r6(g.point_distance(*p, s.x2, s.y2))))


@query("geo_seg_angle", """
SELECT drawing_id, line_id, round(degrees(atan2(y2-y1, x2-x1)), 6) angle FROM lines_v""")
def _(fx):
    return fx.lines.select("drawing_id", "line_id", r6(g.segment_angle(box())).alias("angle"))


@query("geo_ang_diff", """
WITH a AS (SELECT drawing_id, line_id, degrees(atan2(y2-y1, x2-x1)) a, (line_id*37)%360-180 b FROM lines_v),
d AS (SELECT *, least(abs(a-b)%360.0, 360.0-abs(a-b)%360.0) d, abs((a%180+180)%180-(b%180+180)%180) f FROM a)
SELECT drawing_id, line_id, round(least(d, abs(d-180.0)), 6) diff,
  round(CASE WHEN f > 90 THEN 180-f ELSE f END, 6) folded FROM d""")
def _(fx):
    a, b = g.segment_angle(box()), ((F.col("line_id") * 37) % 360 - 180).cast("double")
    return fx.lines.select("drawing_id", "line_id", *named(
        diff=r6(g.angle_difference(a, b)), folded=r6(g.folded_angle_difference(a, b))))


@query("geo_project", SYMBOL_LINE + """, u AS (SELECT *, atan2(y2-y1, x2-x1) r FROM sl)
SELECT drawing_id, line_id, round(cos(r), 6) ux, round(sin(r), 6) uy,
  round((px-x1)*cos(r)+(py-y1)*sin(r), 6) pos FROM u""")
def _(fx):
    s = box()
    ux, uy = g.unit_direction(g.segment_angle(s))
    pos = g.project(F.col("px"), F.col("py"), s.x1, s.y1, ux, uy)
    return _symbol_line(fx).select("drawing_id", "line_id",
                                   *named(ux=r6(ux), uy=r6(uy), pos=r6(pos)))


@query("geo_iou", PAIRS + """
SELECT drawing_id, det_id, round(CASE WHEN inter <= 0 THEN 0.0 ELSE inter/greatest(1e-6, a_area+b_area-inter) END, 6) iou,
  round(CASE WHEN inter <= 0 THEN 0.0 ELSE inter/(a_area+b_area-inter+1e-9) END, 6) iou_plain FROM measured""")
def _(fx):
    a, b = box("a_"), box("b_")
    return _pairs(fx).select("drawing_id", "det_id", *named(
        iou=r6(g.iou(a, b)), iou_plain=r6(g.iou_plain(a, b))))


@query("geo_box_dist", PAIRS + """
SELECT drawing_id, det_id, round(sqrt(power(greatest(0, bx1-ax2, ax1-bx2), 2)
  + power(greatest(0, by1-ay2, ay1-by2), 2)), 6) gap FROM measured""")
def _(fx):
    return _pairs(fx).select("drawing_id", "det_id",
                             r6(g.box_gap(box("a_"), box("b_"))).alias("gap"))


@query("geo_alignment", PAIRS + """, d AS (SELECT *, abs((ax1+ax2)/2.0-(bx1+bx2)/2.0) dx, abs((ay1+ay2)/2.0-(by1+by2)/2.0) dy,
  greatest(1.0, ((ax2-ax1)+(bx2-bx1))/2.0) mw, greatest(1.0, ((ay2-ay1)+(by2-by1))/2.0) mh FROM measured),
s AS (SELECT *, greatest(CASE WHEN dx > 0 THEN 1-least(dy/mh, 1.0) ELSE 1.0 END,
  CASE WHEN dy > 0 THEN 1-least(dx/mw, 1.0) ELSE 1.0 END) score FROM d)
SELECT drawing_id, det_id, round(CASE WHEN (NOT (ax2 < bx1 OR bx2 < ax1)) OR (NOT (ay2 < by1 OR by2 < ay1))
  THEN least(score*1.2, 1.0) ELSE score*0.8 END, 6) score FROM s""")
def _(fx):
    return _pairs(fx).select("drawing_id", "det_id",
                             r6(g.alignment(box("a_"), box("b_"))).alias("score"))


@query("geo_containment", PAIRS + """
SELECT drawing_id, det_id, round((greatest(0, least(ax2, bx2+20)-greatest(ax1, bx1-20))
  * greatest(0, least(ay2, by2+20)-greatest(ay1, by1-20)))/greatest(a_area, 1), 6) share FROM measured""")
def _(fx):
    return _pairs(fx).select("drawing_id", "det_id",
                             r6(g.containment(box("a_"), box("b_"), 20)).alias("share"))


@query("geo_union_box", PAIRS + """
SELECT drawing_id, det_id, least(ax1, bx1) x1, least(ay1, by1) y1, greatest(ax2, bx2) x2, greatest(ay2, by2) y2
FROM measured""")
def _(fx):
    return _pairs(fx).select("drawing_id", "det_id",
                             *box_columns(g.union_box(box("a_"), box("b_"))))


@query("geo_overlap_1d", PAIRS + """, o AS (SELECT *,
  greatest(0, least(ax2,bx2)-greatest(ax1,bx1))/greatest(1, least(ax2-ax1, bx2-bx1)) xo,
  greatest(0, least(ay2,by2)-greatest(ay1,by1))/greatest(1, least(ay2-ay1, by2-by1)) yo FROM measured)
SELECT drawing_id, det_id, round(xo, 6) x_overlap, round(yo, 6) y_overlap,
  yo >= 0.55 same_line, xo >= 0.55 v_stack FROM o""")
def _(fx):
    a, b = box("a_"), box("b_")
    return _pairs(fx).select("drawing_id", "det_id", *named(
        x_overlap=r6(g.x_overlap(a, b)), y_overlap=r6(g.y_overlap(a, b)),
        same_line=g.same_line(a, b), v_stack=g.stacked(a, b)))


@query("geo_seg_cover", """
WITH sl AS (SELECT l.*, s.x1-10 bx1, s.y1-10 by1, s.x2+60 bx2, s.y2+60 by2,
  sqrt((l.x2-l.x1)*(l.x2-l.x1)+(l.y2-l.y1)*(l.y2-l.y1)) len
  FROM lines_v l JOIN symbols_v s ON l.drawing_id = s.drawing_id AND l.line_id = s.symbol_id),
n AS (SELECT *, greatest(5, CAST(floor(len/4) AS BIGINT)) n FROM sl),
p AS (SELECT *, unnest(range(0, n+1)) i FROM n)
SELECT drawing_id, line_id, round(sum(CASE WHEN len >= 1e-6 AND x1+(i/n)*(x2-x1) BETWEEN bx1 AND bx2
  AND y1+(i/n)*(y2-y1) BETWEEN by1 AND by2 THEN 1 ELSE 0 END)/(any_value(n)+1), 6) share
FROM p GROUP BY drawing_id, line_id""")
def _(fx):
    s = fx.symbols.selectExpr("drawing_id", "symbol_id line_id", "x1-10 b_x1", "y1-10 b_y1",
                              "x2+60 b_x2", "y2+60 b_y2")
    return (fx.lines.join(s, ["drawing_id", "line_id"])
            .select("drawing_id", "line_id", r6(g.cover_share(box(), box("b_"))).alias("share")))


@query("geo_conf", SYMBOL_LINE + """
SELECT drawing_id, line_id, round(greatest(0.0, 1-sqrt(power(px-x1, 2)+power(py-y1, 2))/300.0), 6) confidence FROM sl""")
def _(fx):
    s = box()
    d = g.point_distance(F.col("px"), F.col("py"), s.x1, s.y1)
    return _symbol_line(fx).select("drawing_id", "line_id",
                                   r6(g.confidence(d, 300.0)).alias("confidence"))


@query("geo_path_pos", """
WITH chain AS (SELECT drawing_id, CAST(floor(line_id/5) AS BIGINT) chain_id, line_id%5 member_pos, x1, y1, x2, y2,
  sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) len FROM lines_v),
off AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY drawing_id, chain_id ORDER BY member_pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) start FROM chain),
pt AS (SELECT o.*, (s.x1+s.x2)/2.0 px, (s.y1+s.y2)/2.0 py FROM off o JOIN symbols_v s
  ON o.drawing_id = s.drawing_id AND o.chain_id = s.symbol_id),
t AS (SELECT *, coalesce(greatest(0.0, least(1.0, ((px-x1)*(x2-x1)+(py-y1)*(y2-y1))
  /nullif((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1), 0))), 0) t FROM pt),
d AS (SELECT *, sqrt((px-(x1+t*(x2-x1)))*(px-(x1+t*(x2-x1)))+(py-(y1+t*(y2-y1)))*(py-(y1+t*(y2-y1)))) d FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY drawing_id, chain_id ORDER BY d, member_pos) rn FROM d)
SELECT drawing_id, chain_id, member_pos, round(start+t*len, 6) pos FROM r WHERE rn = 1""")
def _(fx):
    # Chains of five lines each, and the symbol of the chain's number on its path.
    members = fx.lines.selectExpr("drawing_id", "CAST(floor(line_id/5) AS BIGINT) chain_id",
                                  "line_id%5 member_pos", "x1", "y1", "x2", "y2")
    points = fx.symbols.select("drawing_id", F.col("symbol_id").alias("chain_id"),
                               *(c.alias(n) for c, n in zip(g.center(box()), ("px", "py"))))
    return (graph.path_positions(members, points, ["drawing_id", "chain_id"])
            .select("drawing_id", "chain_id", "member_pos", r6("pos").alias("pos")))

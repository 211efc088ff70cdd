"""Joins between symbols, texts, lines, masks, labels and assets."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetweave.functions import geometry as g
from sheetweave.functions.geometry import box
from sheetweave.operators import graph, matching as mt, masks as m
from sheetweave.operators.joining import large
from sheetweave.plans.catalog.registry import query, r6

LINE = ["drawing_id", "line_id"]

ASSIGNED = """
spoken AS (SELECT drawing_id, text_id, trim("text") "text", x1, y1, x2, y2, score FROM texts_v WHERE trim("text") <> ''),
centers AS (SELECT drawing_id, symbol_id, (x1+x2)/2.0 cx, (y1+y2)/2.0 cy FROM symbols_v),
td AS (SELECT t.*, symbol_id, sqrt((cx-greatest(x1, least(cx, x2)))*(cx-greatest(x1, least(cx, x2)))
  + (cy-greatest(y1, least(cy, y2)))*(cy-greatest(y1, least(cy, y2)))) dist
  FROM spoken t JOIN centers c ON t.drawing_id = c.drawing_id),
assigned AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id, text_id ORDER BY dist, symbol_id) rn
  FROM td) q WHERE rn = 1 AND dist <= 100)
"""


@query("join_bbox_override", """
SELECT s.drawing_id, symbol_id, coalesce(d.x1, s.x1) x1, coalesce(d.y1, s.y1) y1, coalesce(d.x2, s.x2) x2,
 coalesce(d.y2, s.y2) y2 FROM symbols_v s LEFT JOIN (SELECT * FROM dets_v WHERE det_id%4 <> 0) d
 ON s.drawing_id = d.drawing_id AND d.det_id = s.symbol_id*3+1""")
def _(fx):
    symbols = fx.symbols.withColumn("mask_id", F.expr("symbol_id*3+1"))
    return (graph.override_boxes(symbols, fx.detections.where("det_id % 4 <> 0"))
            .select("drawing_id", "symbol_id", "x1", "y1", "x2", "y2"))


@query("join_text_assign", "WITH " + ASSIGNED + """
SELECT drawing_id, text_id, symbol_id, round(dist, 6) distance FROM assigned""")
def _(fx):
    return graph.assign_texts(fx.texts, fx.symbols).select(
        "drawing_id", "text_id", "symbol_id", r6("distance").alias("distance"))


@query("join_text_topk", "WITH " + ASSIGNED + """,
r AS (SELECT *, row_number() OVER (PARTITION BY drawing_id, symbol_id ORDER BY dist, text_id) r
 FROM td WHERE dist <= 100)
SELECT drawing_id, symbol_id, text_id, "text", round(dist, 6) distance, r AS "rank" FROM r WHERE r <= 3""")
def _(fx):
    return graph.nearest_texts(fx.texts, fx.symbols).withColumns(
        {"distance": r6("distance"), "rank": F.col("rank").cast("bigint")})


ENDS = """
ends AS (SELECT drawing_id, line_id, direction, 'start' endpoint, x1 px, y1 py FROM lines_v
 UNION ALL SELECT drawing_id, line_id, direction, 'end', x2, y2 FROM lines_v),
ed AS (SELECT e.*, symbol_id, sqrt((px-greatest(x1, least(px, x2)))*(px-greatest(x1, least(px, x2)))
  + (py-greatest(y1, least(py, y2)))*(py-greatest(y1, least(py, y2)))) dist
  FROM ends e JOIN symbols_v s ON e.drawing_id = s.drawing_id)
"""


@query("join_line_ends", "WITH " + ENDS + """,
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id, line_id, endpoint
  ORDER BY dist, symbol_id) rn FROM ed) q WHERE rn = 1 AND dist <= 50),
j AS (SELECT l.drawing_id, l.line_id, l.direction, a.symbol_id s, a.dist sd, b.symbol_id t, b.dist td FROM lines_v l
  LEFT JOIN best a ON a.drawing_id = l.drawing_id AND a.line_id = l.line_id AND a.endpoint = 'start'
  LEFT JOIN best b ON b.drawing_id = l.drawing_id AND b.line_id = l.line_id AND b.endpoint = 'end'),
v AS (SELECT *, CASE direction WHEN 'none' THEN s IS NOT NULL AND t IS NOT NULL WHEN 'forward' THEN s IS NOT NULL
  WHEN 'backward' THEN t IS NOT NULL WHEN 'bidirectional' THEN s IS NOT NULL OR t IS NOT NULL ELSE false END ok FROM j)
SELECT drawing_id, line_id, direction, CASE WHEN ok THEN s END source, CASE WHEN ok THEN t END target,
 round(sd, 6) source_distance, round(td, 6) target_distance,
 CASE WHEN s IS NOT NULL AND t IS NOT NULL THEN 'full' ELSE 'partial' END connection_type,
 CASE WHEN sd IS NOT NULL THEN round(greatest(0.0, 1-sd/50.0), 6) END source_confidence,
 CASE WHEN td IS NOT NULL THEN round(greatest(0.0, 1-td/50.0), 6) END target_confidence FROM v""")
def _(fx):
    ends = graph.connect_ends(fx.lines, fx.symbols, 50.0)
    return ends.withColumns({c: r6(c) for c in ends.columns
                             if c.endswith("_distance") or c.endswith("_confidence")})


@query("join_line_multi", "WITH " + ENDS + """,
r AS (SELECT *, row_number() OVER (PARTITION BY drawing_id, line_id ORDER BY dist, symbol_id, endpoint DESC) r
  FROM ed WHERE dist <= 50)
SELECT drawing_id, line_id, symbol_id, endpoint, round(dist, 6) distance, r AS "rank" FROM r WHERE r <= 10""")
def _(fx):
    hits = graph.symbols_at_ends(fx.lines, fx.symbols)
    return hits.withColumns({"distance": r6("distance"), "rank": F.col("rank").cast("bigint")})


HITS = """
members AS (SELECT *, {chain} chain_id, {pos} member_pos, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) len FROM lines_v),
off AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY drawing_id, chain_id ORDER BY member_pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) start FROM members),
p AS (SELECT o.*, symbol_id, s.x1 sx1, s.y1 sy1, s.x2 sx2, s.y2 sy2, (s.x1+s.x2)/2.0 cx, (s.y1+s.y2)/2.0 cy
  FROM off o JOIN symbols_v s ON o.drawing_id = s.drawing_id),
pt AS (SELECT *, coalesce(greatest(0.0, least(1.0, ((cx-x1)*(x2-x1)+(cy-y1)*(y2-y1))
  /nullif((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1), 0))), 0) t FROM p),
pd AS (SELECT *, sqrt((cx-(x1+t*(x2-x1)))*(cx-(x1+t*(x2-x1)))+(cy-(y1+t*(y2-y1)))*(cy-(y1+t*(y2-y1)))) cd,
  least(sqrt(power(x1-greatest(sx1, least(x1, sx2)), 2)+power(y1-greatest(sy1, least(y1, sy2)), 2)),
    sqrt(power(x2-greatest(sx1, least(x2, sx2)), 2)+power(y2-greatest(sy1, least(y2, sy2)), 2))) ed FROM pt),
hits AS (SELECT drawing_id, chain_id, symbol_id, min(least(cd, ed)) distance,
  min(CASE WHEN least(cd, ed) <= {reach} THEN member_pos END) first_member,
  arg_min(start+t*len, {{'d': cd, 'm': member_pos}}) pos
  FROM pd GROUP BY drawing_id, chain_id, symbol_id HAVING min(least(cd, ed)) <= {reach})
"""
BY_FIVE = HITS.format(chain="CAST(floor(line_id/5) AS BIGINT)", pos="line_id%5", reach=50)
BY_LINE = HITS.format(chain="line_id", pos="0", reach=50)


def own_chains(fx):
    """Every line as a chain of its own."""
    return fx.lines.withColumns({"chain_id": F.col("line_id"), "member_pos": F.lit(0).cast("bigint"),
                                 "start": F.lit(0.0)})


def chains_of_five(fx):
    members = fx.lines.withColumns({"chain_id": F.expr("CAST(floor(line_id/5) AS BIGINT)"),
                                    "member_pos": F.expr("line_id % 5")})
    return graph.member_offsets(members, ["drawing_id", "chain_id"])


@query("join_chain_symbols", "WITH " + BY_FIVE + """
SELECT drawing_id, chain_id, symbol_id, round(distance, 6) distance, first_member, round(pos, 6) pos FROM hits""")
def _(fx):
    hits = graph.chain_hits(chains_of_five(fx), fx.symbols, 50.0)
    return hits.withColumns({"distance": r6("distance"), "pos": r6("pos")})


@query("join_endpoint_near", """
WITH e AS (SELECT DISTINCT drawing_id, line_type, px, py FROM (
 SELECT drawing_id, line_type, x1 px, y1 py FROM lines_v UNION ALL
 SELECT drawing_id, line_type, x2, y2 FROM lines_v) q)
SELECT a.drawing_id, a.line_type, a.px a_px, a.py a_py, b.px b_px, b.py b_py FROM e a JOIN e b
ON a.drawing_id = b.drawing_id AND a.line_type = b.line_type
WHERE (a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py) < 625 AND (a.px < b.px OR (a.px = b.px AND a.py <= b.py))""")
def _(fx):
    return graph.near_endpoints(fx.lines, 25.0)


@query("join_collinear", """
WITH l AS (SELECT drawing_id, line_id, x1, y1, x2, y2, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) len,
  degrees(atan2(y2-y1, x2-x1)) ang FROM lines_v),
p AS (SELECT a.drawing_id, a.line_id a, b.line_id b, a.x1 ax1, a.y1 ay1, a.x2 ax2, a.y2 ay2, a.len al, a.ang aa,
  b.x1 bx1, b.y1 by1, b.x2 bx2, b.y2 by2, b.len bl, b.ang ba, cos(radians(a.ang)) ux, sin(radians(a.ang)) uy
  FROM l a JOIN l b ON a.drawing_id = b.drawing_id AND a.line_id < b.line_id WHERE a.len >= 1 AND b.len >= 1),
q AS (SELECT *, least(abs(aa-ba)%360.0, 360.0-abs(aa-ba)%360.0) d,
  least(abs((ax2-ax1)*(by1-ay1)-(ay2-ay1)*(bx1-ax1))/(al+1e-9), abs((ax2-ax1)*(by2-ay1)-(ay2-ay1)*(bx2-ax1))/(al+1e-9),
    abs((bx2-bx1)*(ay1-by1)-(by2-by1)*(ax1-bx1))/(bl+1e-9), abs((bx2-bx1)*(ay2-by1)-(by2-by1)*(ax2-bx1))/(bl+1e-9)) perp,
  (ax2-ax1)*ux+(ay2-ay1)*uy ta, (bx1-ax1)*ux+(by1-ay1)*uy tb1, (bx2-ax1)*ux+(by2-ay1)*uy tb2 FROM p)
SELECT drawing_id, a, b FROM q WHERE least(d, abs(d-180.0)) <= 5 AND perp <= 20
 AND greatest(least(0, ta), least(tb1, tb2)) - least(greatest(0, ta), greatest(tb1, tb2)) <= 30""")
def _(fx):
    return mt.collinear_pairs(fx.lines)


@query("join_iou_pairs", """
WITH p AS (SELECT a.drawing_id, a.det_id a, b.det_id b,
  (least(a.x2, b.x2)-greatest(a.x1, b.x1))*(least(a.y2, b.y2)-greatest(a.y1, b.y1)) inter,
  (a.x2-a.x1)*(a.y2-a.y1)+(b.x2-b.x1)*(b.y2-b.y1) areas
  FROM dets_v a JOIN dets_v b ON a.drawing_id = b.drawing_id AND a.det_id < b.det_id
  AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2)
SELECT drawing_id, a, b, round(inter/(areas-inter), 6) iou FROM p WHERE inter/(areas-inter) > 0.3""")
def _(fx):
    return mt.overlapping_pairs(fx.detections, "det_id", 0.3).withColumn("iou", r6("iou"))


@query("join_mask_overlap", """
SELECT a.drawing_id, a.mask_id a, b.mask_id b,
  CAST(sum(least(a.x_end, b.x_end)-greatest(a.x_start, b.x_start)) AS BIGINT) pixels
FROM runs_v a JOIN runs_v b ON a.drawing_id = b.drawing_id AND a.y = b.y AND a.mask_id < b.mask_id
WHERE a.x_start < b.x_end AND b.x_start < a.x_end GROUP BY a.drawing_id, a.mask_id, b.mask_id""")
def _(fx):
    return m.overlaps(fx.runs, fx.runs, ordered=True)


@query("join_label_map", """
WITH lab AS (SELECT DISTINCT cluster_id, concat('kind-', cluster_id) lb FROM clusters_v WHERE cluster_id%3 <> 0)
SELECT vec_id, c.cluster_id, coalesce(lb, 'unlabeled') category FROM clusters_v c
LEFT JOIN lab ON lab.cluster_id = c.cluster_id""")
def _(fx):
    labels = (fx.clusters.where("cluster_id % 3 <> 0").select("cluster_id").distinct()
              .withColumn("label", F.expr("concat('kind-', cluster_id)")))
    return mt.map_labels(fx.clusters, labels).select("vec_id", "cluster_id", "category")


@query("join_reload_labels", """
WITH saved AS (SELECT drawing_id, symbol_id pos, symbol_id*2 mask_id, symbol_id%7 cluster_id, category FROM symbols_v),
names AS (SELECT drawing_id, cluster_id, arg_max(category, pos) category FROM saved GROUP BY drawing_id, cluster_id)
SELECT s.drawing_id, s.symbol_id, coalesce(v.cluster_id, 0) cluster_id, coalesce(n.category, 'unlabeled') category
FROM symbols_v s LEFT JOIN saved v ON s.drawing_id = v.drawing_id AND s.symbol_id = v.mask_id
LEFT JOIN names n ON n.drawing_id = s.drawing_id AND n.cluster_id = coalesce(v.cluster_id, 0)""")
def _(fx):
    saved = fx.symbols.selectExpr(
        "drawing_id", "symbol_id pos", "symbol_id*2 mask_id", "symbol_id%7 cluster_id", "category")
    symbols = fx.symbols.selectExpr("drawing_id", "symbol_id", "symbol_id mask_id")
    return mt.reload_labels(symbols, saved).select("drawing_id", "symbol_id", "cluster_id", "category")


@query("join_point_pick", """
WITH pts AS (SELECT drawing_id, symbol_id point_id, CAST(floor((x1+x2)/2) AS BIGINT) px,
  CAST(floor((y1+y2)/2) AS BIGINT) py FROM symbols_v),
bx AS (SELECT p.drawing_id, point_id, max(text_id) picked_text FROM pts p JOIN texts_v t ON p.drawing_id = t.drawing_id
  AND px BETWEEN x1-20 AND x2+20 AND py BETWEEN y1-20 AND y2+20 GROUP BY p.drawing_id, point_id),
mk AS (SELECT p.drawing_id, point_id, max(mask_id) picked_mask FROM pts p JOIN runs_v r ON p.drawing_id = r.drawing_id
  AND py = y AND px >= x_start AND px < x_end GROUP BY p.drawing_id, point_id)
SELECT p.drawing_id, p.point_id, picked_text, picked_mask FROM pts p
LEFT JOIN bx ON bx.drawing_id = p.drawing_id AND bx.point_id = p.point_id
LEFT JOIN mk ON mk.drawing_id = p.drawing_id AND mk.point_id = p.point_id""")
def _(fx):
    points = fx.symbols.selectExpr("drawing_id", "symbol_id point_id",
                                   "CAST(floor((x1+x2)/2) AS BIGINT) px", "CAST(floor((y1+y2)/2) AS BIGINT) py")
    texts = fx.texts.selectExpr("drawing_id", "text_id", "x1-20 x1", "y1-20 y1", "x2+20 x2", "y2+20 y2")
    key = ["drawing_id", "point_id"]
    return (points.select(*key)
            .join(large(mt.topmost_box(points, texts, "text_id").withColumnRenamed("picked", "picked_text")), key, "left")
            .join(large(mt.topmost_mask(points, fx.runs).withColumnRenamed("picked", "picked_mask")), key, "left"))


@query("join_line_pick", """
WITH pts AS (SELECT drawing_id, symbol_id point_id, (x1+x2)/2.0 cx, (y1+y2)/2.0 cy FROM symbols_v),
p AS (SELECT pts.*, line_id, line_type, x1, y1, x2, y2 FROM pts JOIN lines_v l ON pts.drawing_id = l.drawing_id),
pt AS (SELECT *, coalesce(greatest(0.0, least(1.0, ((cx-x1)*(x2-x1)+(cy-y1)*(y2-y1))
  /nullif((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1), 0))), 0) t FROM p),
d AS (SELECT *, sqrt((cx-(x1+t*(x2-x1)))*(cx-(x1+t*(x2-x1)))+(cy-(y1+t*(y2-y1)))*(cy-(y1+t*(y2-y1)))) d FROM pt),
r AS (SELECT *, row_number() OVER (PARTITION BY drawing_id, point_id
  ORDER BY d, CASE WHEN line_type = 'solid' THEN 0 ELSE 1 END, line_id) rn FROM d WHERE d < 5)
SELECT drawing_id, point_id, line_id, line_type, round(d, 6) distance FROM r WHERE rn = 1""")
def _(fx):
    cx, cy = g.center(box())
    points = fx.symbols.select("drawing_id", F.col("symbol_id").alias("point_id"),
                               cx.alias("px"), cy.alias("py"))
    return mt.nearest_line(points, fx.lines).withColumn("distance", r6("distance"))


@query("join_patch_assets", """
WITH img AS (SELECT drawing_id FROM drawings_v WHERE width%5 <> 0),
ann AS (SELECT DISTINCT drawing_id FROM texts_v)
SELECT drawing_id, EXISTS (SELECT 1 FROM img WHERE img.drawing_id = d.drawing_id)
 AND EXISTS (SELECT 1 FROM ann WHERE ann.drawing_id = d.drawing_id) usable FROM drawings_v d""")
def _(fx):
    drawings = fx.drawings
    images, annotations = drawings.where("width % 5 <> 0"), fx.texts
    good = mt.with_assets(drawings, images, annotations).select("drawing_id", F.lit(True).alias("usable"))
    bad = mt.without_assets(drawings, images, annotations).select("drawing_id", F.lit(False).alias("usable"))
    return good.unionByName(bad)

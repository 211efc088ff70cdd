"""Edit logs replayed over masks, texts and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetweave.functions import geometry as g
from sheetweave.functions.geometry import box
from sheetweave.operators import editlog, edits as ed
from sheetweave.operators.joining import large
from sheetweave.plans.catalog.registry import query, r6

PLACE = ["x1", "y1", "x2", "y2"]


@query("edit_delete", """
WITH d AS (SELECT DISTINCT drawing_id, target_a symbol_id FROM edits_v WHERE op = 'delete')
SELECT drawing_id, symbol_id FROM symbols_v s WHERE NOT EXISTS
 (SELECT 1 FROM d WHERE d.drawing_id = s.drawing_id AND d.symbol_id = s.symbol_id)""")
def _(fx):
    deleted = fx.edits.where("op = 'delete'").selectExpr("drawing_id", "target_a symbol_id")
    return ed.without(fx.symbols, deleted, "symbol_id").select("drawing_id", "symbol_id")


@query("edit_combine_mask", """
WITH ch AS (SELECT drawing_id, CAST(floor(det_id/10) AS BIGINT) sel, det_id mask_id FROM dets_v WHERE det_id%10 IN (0, 1, 2, 5)),
lo AS (SELECT *, min(mask_id) OVER (PARTITION BY drawing_id, sel) low FROM ch),
px AS (SELECT DISTINCT r.drawing_id, low, y, unnest(range(x_start, x_end)) x FROM runs_v r JOIN lo
  ON lo.drawing_id = r.drawing_id AND lo.mask_id = r.mask_id),
a AS (SELECT drawing_id, low, min(x) x1, min(y) y1, max(x)+1 x2, max(y)+1 y2, count(*) area FROM px GROUP BY drawing_id, low),
sc AS (SELECT d.drawing_id, low, avg(score) score FROM dets_v d JOIN lo ON lo.drawing_id = d.drawing_id AND lo.mask_id = d.det_id
  GROUP BY d.drawing_id, low)
SELECT a.drawing_id, a.low mask_id, round(score, 6) score, x1, y1, x2, y2, area FROM a JOIN sc ON a.drawing_id = sc.drawing_id AND a.low = sc.low
UNION ALL SELECT drawing_id, det_id, round(score, 6), x1, y1, x2, y2, (x2-x1)*(y2-y1) FROM dets_v WHERE det_id%10 NOT IN (0, 1, 2, 5)""")
def _(fx):
    masks = fx.detections.selectExpr("drawing_id", "det_id mask_id", "score", *PLACE, "(x2-x1)*(y2-y1) area")
    chosen = masks.where("mask_id%10 IN (0, 1, 2, 5)").selectExpr(
        "drawing_id", "CAST(floor(mask_id/10) AS BIGINT) selection", "mask_id")
    return ed.combine_masks(masks, fx.runs, chosen).withColumn("score", r6("score"))


@query("edit_combine_text", """
WITH ch AS (SELECT *, CAST(floor(text_id/6) AS BIGINT) sel FROM texts_v WHERE text_id%6 IN (1, 2, 4)),
n AS (SELECT *, count(*) OVER (PARTITION BY drawing_id, sel) n FROM ch)
SELECT drawing_id, min(text_id) text_id, min(x1) x1, min(y1) y1, max(x2) x2, max(y2) y2,
 string_agg("text", ' ' ORDER BY (text_id*31)%75) "text", round(avg(score), 6) score FROM n WHERE n >= 2 GROUP BY drawing_id, sel
UNION ALL SELECT drawing_id, text_id, x1, y1, x2, y2, "text", round(score, 6) FROM texts_v t WHERE NOT EXISTS
 (SELECT 1 FROM n WHERE n.n >= 2 AND n.drawing_id = t.drawing_id AND n.text_id = t.text_id)""")
def _(fx):
    chosen = fx.texts.where("text_id%6 IN (1, 2, 4)").selectExpr(
        "drawing_id", "CAST(floor(text_id/6) AS BIGINT) selection", "text_id", "(text_id*31)%75 place")
    return ed.combine_texts(fx.texts, chosen).withColumn("score", r6("score"))


@query("edit_combine_line", """
WITH ch AS (SELECT *, CAST(floor(line_id/15) AS BIGINT) sel FROM lines_v WHERE line_id%15 IN (0, 3, 6, 1)
  AND (line_id%15 <> 1 OR line_id%2 = 0)),
v AS (SELECT drawing_id, sel, min(line_type) line_type, CASE count(DISTINCT direction) FILTER (WHERE direction <> 'none') WHEN 0 THEN 'none'
  WHEN 1 THEN max(direction) FILTER (WHERE direction <> 'none') ELSE 'bidirectional' END direction
  FROM ch GROUP BY drawing_id, sel HAVING count(*) >= 2 AND min(line_type) = max(line_type)),
m AS (SELECT ch.* FROM ch JOIN v ON v.drawing_id = ch.drawing_id AND v.sel = ch.sel),
e AS (SELECT drawing_id, sel, line_id*2 idx, x1 px, y1 py FROM m UNION ALL SELECT drawing_id, sel, line_id*2+1, x2, y2 FROM m),
p AS (SELECT a.drawing_id, a.sel, a.px x1, a.py y1, b.px x2, b.py y2, row_number() OVER (PARTITION BY a.drawing_id, a.sel
  ORDER BY (a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py) DESC, a.idx, b.idx) rn FROM e a JOIN e b
  ON a.drawing_id = b.drawing_id AND a.sel = b.sel AND a.idx < b.idx),
l AS (SELECT drawing_id, max(line_id) last FROM lines_v GROUP BY drawing_id)
SELECT p.drawing_id, last + row_number() OVER (PARTITION BY p.drawing_id ORDER BY p.sel) line_id, line_type, direction, x1, y1, x2, y2
FROM p JOIN v ON v.drawing_id = p.drawing_id AND v.sel = p.sel JOIN l ON l.drawing_id = p.drawing_id WHERE rn = 1
UNION ALL SELECT drawing_id, line_id, line_type, direction, x1, y1, x2, y2 FROM lines_v q WHERE NOT EXISTS
 (SELECT 1 FROM m WHERE m.drawing_id = q.drawing_id AND m.line_id = q.line_id)""")
def _(fx):
    chosen = fx.lines.where("line_id%15 IN (0, 3, 6, 1) AND (line_id%15 <> 1 OR line_id%2 = 0)").selectExpr(
        "drawing_id", "CAST(floor(line_id/15) AS BIGINT) selection", "line_id")
    return ed.combine_lines(fx.lines, chosen)


@query("edit_resize", """
SELECT s.drawing_id, symbol_id mask_id,
 CASE WHEN symbol_id%3 = 0 THEN greatest(0, least(x1-30, width-1)) ELSE x1 END x1,
 CASE WHEN symbol_id%3 = 0 THEN greatest(0, least(y1-30, height-1)) ELSE y1 END y1,
 CASE WHEN symbol_id%3 = 0 THEN greatest(greatest(0, least(x1-30, width-1))+1, least(x2+90, width)) ELSE x2 END x2,
 CASE WHEN symbol_id%3 = 0 THEN greatest(greatest(0, least(y1-30, height-1))+1, least(y2+90, height)) ELSE y2 END y2
FROM symbols_v s JOIN drawings_v d ON s.drawing_id = d.drawing_id""")
def _(fx):
    masks = fx.symbols.selectExpr("drawing_id", "symbol_id mask_id", *PLACE)
    changes = masks.where("mask_id % 3 = 0").selectExpr(
        "drawing_id", "mask_id", "x1-30 x1", "y1-30 y1", "x2+90 x2", "y2+90 y2")
    return ed.resize_boxes(masks, changes, fx.drawings)


@query("edit_create", """
WITH b AS (SELECT e.drawing_id, seq, least(target_a*15, target_b*15) x1, greatest(target_a*15, target_b*15) x2,
  least(target_b*9, target_a*9+4) y1, greatest(target_b*9, target_a*9+4) y2, width, height
  FROM edits_v e JOIN drawings_v d ON e.drawing_id = d.drawing_id WHERE op = 'combine'),
c AS (SELECT *, greatest(0, least(x1, width-1)) cx, greatest(0, least(y1, height-1)) cy FROM b WHERE x2-x1 >= 5 AND y2-y1 >= 5)
SELECT drawing_id, seq, cx x1, cy y1, greatest(cx+1, least(x2, width)) x2, greatest(cy+1, least(y2, height)) y2, 1.0::DOUBLE score FROM c""")
def _(fx):
    drawn = fx.edits.where("op = 'combine'").selectExpr(
        "drawing_id", "seq", "target_a*15 x1", "target_b*9 y1", "target_b*15 x2", "target_a*9+4 y2")
    return ed.create_boxes(drawn, fx.drawings)


@query("edit_create_line", """
SELECT drawing_id, seq, target_a x1, target_b y1, target_a+seq%7 x2, target_b+seq%5 y2, 'solid' line_type, 'none' direction
FROM edits_v WHERE op = 'combine' AND sqrt((seq%7)*(seq%7)+(seq%5)*(seq%5)) >= 5""")
def _(fx):
    drawn = fx.edits.where("op = 'combine'").selectExpr(
        "drawing_id", "seq", "target_a x1", "target_b y1", "target_a+seq%7 x2", "target_b+seq%5 y2",
        "'solid' line_type", "'none' direction")
    return ed.create_lines(drawn)


@query("edit_text_value", """
WITH c AS (SELECT drawing_id, target_a text_id, arg_max(concat('T-', target_b), seq) v FROM edits_v WHERE op = 'combine' GROUP BY drawing_id, target_a)
SELECT t.drawing_id, t.text_id, coalesce(v, "text") "text" FROM texts_v t LEFT JOIN c ON c.drawing_id = t.drawing_id AND c.text_id = t.text_id""")
def _(fx):
    changes = fx.edits.where("op = 'combine'").selectExpr(
        "drawing_id", "target_a text_id", "seq", "concat('T-', target_b) value")
    return ed.set_texts(fx.texts, changes).select("drawing_id", "text_id", "text")


DIRS = "['none','forward','backward','bidirectional','coming_in','going_out']"


@query("edit_direction", f"""
WITH s AS (SELECT drawing_id, target_a line_id, arg_max({DIRS}[target_b%6+1], seq) v FROM edits_v WHERE op = 'set_direction' GROUP BY drawing_id, target_a),
l AS (SELECT l.drawing_id, l.line_id, coalesce(v, direction) direction FROM lines_v l LEFT JOIN s ON s.drawing_id = l.drawing_id AND s.line_id = l.line_id),
c AS (SELECT DISTINCT drawing_id, target_b line_id FROM edits_v WHERE op = 'combine' AND target_b%2 = 0)
SELECT l.drawing_id, l.line_id, CASE WHEN c.line_id IS NOT NULL THEN {DIRS}[list_position({DIRS}, direction)%6+1] ELSE direction END direction
FROM l LEFT JOIN c ON c.drawing_id = l.drawing_id AND c.line_id = l.line_id""")
def _(fx):
    names = "array('none','forward','backward','bidirectional','coming_in','going_out')"
    changes = fx.edits.where("op = 'set_direction'").selectExpr(
        "drawing_id", "target_a line_id", "seq", f"element_at({names}, CAST(target_b%6+1 AS INT)) value")
    cycled = fx.edits.where("op = 'combine' AND target_b%2 = 0").selectExpr("drawing_id", "target_b line_id")
    lines = ed.set_directions(fx.lines, changes)
    return ed.cycle_directions(lines, cycled).select("drawing_id", "line_id", "direction")


# Walks the log with the edits that are in force and those that redo could bring back.
IN_FORCE = """
WITH RECURSIVE o AS (SELECT drawing_id, seq, op, row_number() OVER (PARTITION BY drawing_id ORDER BY seq) rn FROM edits_v),
walk AS (SELECT drawing_id, CAST(0 AS BIGINT) rn, CAST([] AS BIGINT[]) applied, 0 depth, CAST([] AS BIGINT[]) undone
  FROM (SELECT DISTINCT drawing_id FROM o) q
 UNION ALL SELECT o.drawing_id, o.rn,
  CASE WHEN op = 'undo' THEN CASE WHEN depth > 0 THEN applied[:-2] ELSE applied END
   WHEN op = 'redo' THEN CASE WHEN len(undone) > 0 THEN list_append(applied, undone[-1]) ELSE applied END
   ELSE list_append(applied, seq) END,
  CASE WHEN op = 'undo' THEN greatest(depth-1, 0) WHEN op = 'redo' AND len(undone) = 0 THEN depth ELSE least(depth+1, 50) END,
  CASE WHEN op = 'undo' THEN CASE WHEN depth > 0 THEN list_append(undone, applied[-1]) ELSE undone END
   WHEN op = 'redo' THEN undone[:-2] ELSE [] END
 FROM walk w JOIN o ON o.drawing_id = w.drawing_id AND o.rn = w.rn+1),
final AS (SELECT drawing_id, applied FROM walk QUALIFY row_number() OVER (PARTITION BY drawing_id ORDER BY rn DESC) = 1)"""


@query("edit_undo_redo", IN_FORCE + " SELECT drawing_id, unnest(applied) seq FROM final")
def _(fx):
    return editlog.surviving_edits(fx.edits).select("drawing_id", "seq")


# A log that also creates lines, and names lines that earlier edits have made (ids from 150 on).
MIXED = """SELECT drawing_id, seq, CASE WHEN op = 'set_direction' THEN 'direction' WHEN op = 'combine' AND seq%3 = 0 THEN 'create'
  ELSE op END op, {targets} targets,
  CASE WHEN op = 'set_direction' THEN CASE target_b%6 WHEN 0 THEN 'none' WHEN 1 THEN 'forward' WHEN 2 THEN 'backward'
    WHEN 3 THEN 'bidirectional' WHEN 4 THEN 'coming_in' ELSE 'going_out' END END val,
  CASE WHEN target_a%2 = 0 THEN 'solid' ELSE 'dashed' END line_type, target_a x1, target_b y1, target_a+seq%7 x2, target_b+seq%5*9 y2
FROM {edits}"""
ENDS = ("list_concat(list_transform(m, lambda l: {'i': l.id*2, 'x': l.x1, 'y': l.y1}),"
        " list_transform(m, lambda l: {'i': l.id*2+1, 'x': l.x2, 'y': l.y2}))")
FURTHEST = (f"list_max(flatten(list_transform({ENDS}, lambda p: list_transform(list_filter({ENDS}, lambda q: q.i > p.i), lambda q:"
            " {'d': (p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y), 'i': -p.i, 'j': -q.i, 'x1': p.x, 'y1': p.y, 'x2': q.x, 'y2': q.y}))))")
WAYS = "list_distinct(list_filter(list_transform(m, lambda l: l.d), lambda d: d <> 'none'))"


@query("edit_replay", IN_FORCE + f""",
kept AS (SELECT drawing_id, unnest(applied) seq FROM final),
ops AS (SELECT e.*, row_number() OVER (PARTITION BY drawing_id ORDER BY seq) rn,
  149 + sum(CASE WHEN op IN ('combine', 'create') THEN 1 ELSE 0 END) OVER (PARTITION BY drawing_id ORDER BY seq)::BIGINT made
  FROM ({MIXED.format(edits="edits_v", targets="[target_a*2, target_b, target_a]")}) e JOIN kept USING (drawing_id, seq)),
replay(drawing_id, rn, ls) USING KEY (drawing_id) AS (
 SELECT drawing_id, 0::BIGINT, list({{'id': line_id, 't': line_type, 'd': direction, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}})
  FROM lines_v GROUP BY drawing_id
 UNION
 SELECT drawing_id, rn, CASE op
  WHEN 'delete' THEN list_filter(ls, lambda l: NOT list_contains(targets, l.id))
  WHEN 'direction' THEN list_transform(ls, lambda l: CASE WHEN list_contains(targets, l.id) THEN
    {{'id': l.id, 't': l.t, 'd': val, 'x1': l.x1, 'y1': l.y1, 'x2': l.x2, 'y2': l.y2}} ELSE l END)
  WHEN 'create' THEN CASE WHEN sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) >= 5 THEN
    list_append(ls, {{'id': made, 't': line_type, 'd': 'none', 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) ELSE ls END
  ELSE CASE WHEN len(m) >= 2 AND len(list_distinct(list_transform(m, lambda l: l.t))) = 1 THEN list_append(
    list_filter(ls, lambda l: NOT list_contains(targets, l.id)),
    {{'id': made, 't': m[1].t, 'd': CASE len({WAYS}) WHEN 0 THEN 'none' WHEN 1 THEN {WAYS}[1] ELSE 'bidirectional' END,
      'x1': {FURTHEST}.x1, 'y1': {FURTHEST}.y1, 'x2': {FURTHEST}.x2, 'y2': {FURTHEST}.y2}}) ELSE ls END END
 FROM (SELECT o.*, r.ls, list_filter(r.ls, lambda l: list_contains(o.targets, l.id)) m
   FROM replay r JOIN ops o ON o.drawing_id = r.drawing_id AND o.rn = r.rn + 1) q)
SELECT drawing_id, l.id line_id, l.t line_type, l.d direction, l.x1 x1, l.y1 y1, l.x2 x2, l.y2 y2
FROM (SELECT drawing_id, unnest(ls) l FROM replay)""")
def _(fx):
    log = fx.spark.sql(MIXED.format(edits="{e}", targets="array(target_a*2, target_b, target_a)"), e=fx.edits)
    drawn = log.withColumnRenamed("val", "value").join(large(fx.lines.select("drawing_id").distinct()), "drawing_id", "left_semi")
    return editlog.replay_lines(fx.lines, drawn)


@query("edit_renumber", """
WITH d AS (SELECT DISTINCT drawing_id, target_a det_id FROM edits_v WHERE op = 'delete'),
k AS (SELECT * FROM dets_v q WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.drawing_id = q.drawing_id AND d.det_id = q.det_id))
SELECT drawing_id, det_id, row_number() OVER (PARTITION BY drawing_id ORDER BY det_id) - 1 new_id, (x2-x1)*(y2-y1) area FROM k""")
def _(fx):
    deleted = fx.edits.where("op = 'delete'").selectExpr("drawing_id", "target_a det_id")
    left = ed.renumber(ed.without(fx.detections, deleted, "det_id"), "det_id")
    return left.select("drawing_id", "det_id", "new_id", g.area(box()).alias("area"))

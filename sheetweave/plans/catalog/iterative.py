"""Order-dependent operators. The SQL walks through the rows one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetweave.operators import folds, masks as m, tracks
from sheetweave.operators.foldrules import iou_above, plain_iou_from
from sheetweave.operators.joining import large
from sheetweave.operators.suppression import absorbed_by, suppress
from sheetweave.plans.catalog import sweepsql as sw
from sheetweave.plans.catalog.registry import query

PLACE = ["x1", "y1", "x2", "y2"]


def _shrunk(lines, factor):
    return lines.selectExpr("drawing_id", "line_id", *(
        f"CAST(floor({c}/{factor}) AS BIGINT) {c}" for c in PLACE))


def _crowded(texts, band=24):
    """The texts moved together, so that words of one row and block lie near each other."""
    return texts.selectExpr(
        "drawing_id", "text_id", "floor(x1/8)*6 x1", f"floor(y1/{band})*14 y1", "floor(x1/8)*6+x2-x1 x2",
        f"floor(y1/{band})*14+y2-y1 y2", "text", "score")


# Walks the boxes of every drawing by rank and keeps the list of kept ones.
NMS = """
WITH RECURSIVE ranked AS (SELECT drawing_id, det_id, score, x1, y1, x2, y2,
  row_number() OVER (PARTITION BY drawing_id ORDER BY score DESC, det_id) rn FROM dets_v),
walk AS (SELECT drawing_id, CAST(0 AS BIGINT) rn,
  CAST([] AS STRUCT(id BIGINT, x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT)[]) kept FROM (SELECT DISTINCT drawing_id FROM ranked) q
 UNION ALL
 SELECT r.drawing_id, r.rn, CASE WHEN len(list_filter(kept, lambda k: {hit})) = 0
  THEN list_append(kept, {{'id': det_id, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}}) ELSE kept END
 FROM walk w JOIN ranked r ON r.drawing_id = w.drawing_id AND r.rn = w.rn + 1),
final AS (SELECT drawing_id, kept FROM walk QUALIFY row_number() OVER (PARTITION BY drawing_id ORDER BY rn DESC) = 1),
seeds AS (SELECT drawing_id, unnest(kept) k FROM final)
"""
INTER = ("(greatest(0, least(k.x2, r.x2)-greatest(k.x1, r.x1))*greatest(0, least(k.y2, r.y2)-greatest(k.y1, r.y1)))")
UNION = f"((k.x2-k.x1)*(k.y2-k.y1)+(r.x2-r.x1)*(r.y2-r.y1)-{INTER})"


@query("it_nms_text", NMS.format(hit=f"{INTER} > 0 AND {INTER}/greatest(1e-6, {UNION}) > 0.35") + """
SELECT drawing_id, k.id det_id FROM seeds""")
def _(fx):
    boxes = fx.detections.withColumnRenamed("det_id", "id")
    return suppress(boxes, iou_above(0.35)).selectExpr("drawing_id", "id det_id")


@query("it_nms_merge", NMS.format(hit=f"{INTER} > 0 AND {INTER}/({UNION}+1e-9) >= 0.3") + f""",
absorbed AS (SELECT r.drawing_id, k.id seed, r.x1, r.y1, r.x2, r.y2, row_number() OVER
  (PARTITION BY r.drawing_id, r.det_id ORDER BY (r.det_id = k.id) DESC, s.rn) pick
  FROM ranked r JOIN seeds USING (drawing_id) JOIN ranked s ON s.drawing_id = r.drawing_id AND s.det_id = k.id
  WHERE r.det_id = k.id OR ({INTER} > 0 AND {INTER}/({UNION}+1e-9) >= 0.3))
SELECT a.drawing_id, seed, min(a.x1) x1, min(a.y1) y1, max(a.x2) x2, max(a.y2) y2, any_value(d.score) score
FROM absorbed a JOIN dets_v d ON d.drawing_id = a.drawing_id AND d.det_id = seed WHERE pick = 1 GROUP BY a.drawing_id, seed""")
def _(fx):
    boxes = fx.detections.withColumnRenamed("det_id", "id")
    groups = absorbed_by(boxes, plain_iou_from(0.3))
    return (boxes.join(large(groups), ["drawing_id", "id"]).groupBy("drawing_id", "seed")
            .agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"),
                 F.max("y2").alias("y2"), F.max("score").alias("score")))


# Walks the lines in order with the list of those dropped so far.
DEDUP = """
m AS (SELECT *, (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1) len2 FROM l),
near AS (SELECT a.drawing_id, a.line_id i, list({'j': b.line_id, 'longer': b.len2 > a.len2} ORDER BY b.line_id) js
  FROM m a JOIN m b ON a.drawing_id = b.drawing_id AND a.line_id < b.line_id
  WHERE least(greatest(sqrt(power(a.x1-b.x1, 2)+power(a.y1-b.y1, 2)), sqrt(power(a.x2-b.x2, 2)+power(a.y2-b.y2, 2))),
    greatest(sqrt(power(a.x1-b.x2, 2)+power(a.y1-b.y2, 2)), sqrt(power(a.x2-b.x1, 2)+power(a.y2-b.y1, 2)))) < 25
  GROUP BY a.drawing_id, a.line_id),
steps AS (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY i) step FROM near),
walk AS (SELECT drawing_id, CAST(0 AS BIGINT) step, CAST([] AS BIGINT[]) dropped FROM (SELECT DISTINCT drawing_id FROM l) q
 UNION ALL
 SELECT s.drawing_id, s.step, CASE WHEN list_contains(dropped, i) THEN dropped ELSE list_concat(dropped,
   CASE WHEN len(list_filter(list_filter(js, lambda q: NOT list_contains(dropped, q.j)), lambda q: q.longer)) = 0
    THEN list_transform(list_filter(js, lambda q: NOT list_contains(dropped, q.j)), lambda q: q.j)
    ELSE list_append(list_transform(list_filter(list_filter(js, lambda q: NOT list_contains(dropped, q.j)),
      lambda q: q.j < list_filter(list_filter(js, lambda p: NOT list_contains(dropped, p.j)), lambda p: p.longer)[1].j),
      lambda q: q.j), i) END) END
 FROM walk w JOIN steps s ON s.drawing_id = w.drawing_id AND s.step = w.step + 1),
final AS (SELECT drawing_id, dropped FROM walk QUALIFY row_number() OVER (PARTITION BY drawing_id ORDER BY step DESC) = 1),
distinct_lines AS (SELECT l.*, 0 w FROM l JOIN final f ON f.drawing_id = l.drawing_id WHERE NOT list_contains(dropped, line_id))
"""


@query("it_dedup_lines", """
WITH RECURSIVE l AS (SELECT drawing_id, line_id, CAST(floor(x1/5) AS BIGINT) x1, CAST(floor(y1/5) AS BIGINT) y1,
  CAST(floor(x2/5) AS BIGINT) x2, CAST(floor(y2/5) AS BIGINT) y2 FROM lines_v),""" + DEDUP + """
SELECT drawing_id, line_id FROM distinct_lines""")
def _(fx):
    # The lines on a page a fifth as large, so that many lie near each other.
    return folds.dedup_lines(_shrunk(fx.lines, 5)).select("drawing_id", "line_id")


# Walks line by line: each step either extends the open path or opens the next.
CHAINS = """
WITH RECURSIVE packed AS (SELECT drawing_id, count(*) n,
  list({'id': line_id, 't': line_type, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} ORDER BY line_id) ls
  FROM lines_v GROUP BY drawing_id),
start AS (SELECT drawing_id, n, ls, list_transform(ls, lambda l: true) free,
  CAST(0 AS BIGINT) step, CAST(NULL AS BIGINT) seed, CAST(NULL AS BIGINT) head, CAST(NULL AS BIGINT) tail,
  CAST(NULL AS BIGINT) pick, CAST(NULL AS BOOLEAN) front FROM packed),
walk AS (SELECT * FROM start
 UNION ALL
 SELECT drawing_id, n, ls, list_transform(free, lambda f, i: f AND i <> chosen), step+1,
  CASE WHEN nxt IS NULL THEN chosen ELSE seed END, CASE WHEN nxt IS NULL OR at_front THEN chosen ELSE head END,
  CASE WHEN nxt IS NULL OR NOT at_front THEN chosen ELSE tail END, chosen, nxt IS NOT NULL AND at_front
 FROM (SELECT *, coalesce(nxt, list_filter(range(1, n+1), lambda i: free[i])[1]) chosen,
   nxt IS NOT NULL AND least(sqrt(power(ls[nxt].x1-ls[head].x1, 2)+power(ls[nxt].y1-ls[head].y1, 2)),
     sqrt(power(ls[nxt].x2-ls[head].x1, 2)+power(ls[nxt].y2-ls[head].y1, 2))) < 25 at_front
  FROM (SELECT *, list_filter(range(1, n+1), lambda i: seed IS NOT NULL AND free[i] AND ls[i].t = ls[seed].t AND least(
    sqrt(power(ls[i].x1-ls[head].x1, 2)+power(ls[i].y1-ls[head].y1, 2)), sqrt(power(ls[i].x2-ls[head].x1, 2)+power(ls[i].y2-ls[head].y1, 2)),
    sqrt(power(ls[i].x1-ls[tail].x2, 2)+power(ls[i].y1-ls[tail].y2, 2)), sqrt(power(ls[i].x2-ls[tail].x2, 2)+power(ls[i].y2-ls[tail].y2, 2))) < 25)[1] nxt
   FROM walk WHERE step < n) a) b),
members AS (SELECT drawing_id, ls[seed].id chain_id, ls[pick].id line_id, CASE WHEN front THEN -step ELSE step END o
  FROM walk WHERE step > 0)
"""


@query("it_chain_lines", CHAINS + """
SELECT drawing_id, chain_id, line_id, row_number() OVER (PARTITION BY drawing_id, chain_id ORDER BY o) - 1 member_pos FROM members""")
def _(fx):
    return folds.chain_lines(fx.lines).select("drawing_id", "chain_id", "line_id", "member_pos")


@query("it_line_networks", """
WITH RECURSIVE pts AS (SELECT drawing_id, line_id, line_type, x1 px, y1 py FROM lines_v UNION ALL
  SELECT drawing_id, line_id, line_type, x2, y2 FROM lines_v),
e AS (SELECT DISTINCT a.drawing_id, a.line_id a, b.line_id b FROM pts a JOIN pts b ON a.drawing_id = b.drawing_id
  AND a.line_type = b.line_type AND a.line_id <> b.line_id
  WHERE sqrt(power(a.px-b.px, 2)+power(a.py-b.py, 2)) < 25),
reach AS (SELECT drawing_id, line_id node, line_id start FROM lines_v
 UNION SELECT e.drawing_id, e.b, r.start FROM reach r JOIN e ON e.drawing_id = r.drawing_id AND e.a = r.node)
SELECT drawing_id, node line_id, min(start) network FROM reach GROUP BY drawing_id, node""")
def _(fx):
    return folds.line_networks(fx.lines).select("drawing_id", "line_id", "network")


@query("it_sweep_collinear", """
WITH RECURSIVE c AS (SELECT drawing_id, line_id, CAST(floor(x1/16) AS BIGINT) x1, CAST(floor(y1/16) AS BIGINT) y1,
  CAST(floor(x2/16) AS BIGINT) x2, CAST(floor(y2/16) AS BIGINT) y2 FROM lines_v),
t AS (SELECT *, abs(degrees(atan2(y2-y1, x2-x1+1e-6))) a FROM c),
s AS (SELECT *, CASE WHEN a <= 5.5 OR abs(a-180) <= 5.5 THEN 'h' WHEN abs(a-90) <= 5.5 THEN 'v' END o FROM t),
n AS (SELECT drawing_id, o, line_id, CAST(round_even(CASE WHEN o = 'h' THEN y1+y2 ELSE x1+x2 END/2, 0) AS BIGINT) track,
  CASE WHEN o = 'h' THEN least(x1, x2) ELSE least(y1, y2) END low,
  CASE WHEN o = 'h' THEN greatest(x1, x2) ELSE greatest(y1, y2) END high FROM s WHERE o IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY drawing_id, o ORDER BY track, low, high, line_id) rn FROM n),
walk AS (SELECT drawing_id, o, rn, track, low, high, rn run FROM r WHERE rn = 1
 UNION ALL
 SELECT drawing_id, o, rn, CASE WHEN ok THEN w_track ELSE r_track END, CASE WHEN ok THEN w_low ELSE r_low END,
  CASE WHEN ok THEN greatest(w_high, r_high) ELSE r_high END, CASE WHEN ok THEN run ELSE rn END
 FROM (SELECT r.drawing_id, r.o, r.rn, r.track r_track, r.low r_low, r.high r_high, w.track w_track, w.low w_low,
   w.high w_high, w.run, abs(r.track-w.track) <= 3 AND r.low-w.high BETWEEN 0 AND 7 ok
   FROM walk w JOIN r ON r.drawing_id = w.drawing_id AND r.o = w.o AND r.rn = w.rn+1) q),
last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY drawing_id, o, run ORDER BY rn DESC) = 1)
SELECT drawing_id, o orientation, CASE WHEN o = 'h' THEN low ELSE track END x1, CASE WHEN o = 'h' THEN track ELSE low END y1,
 CASE WHEN o = 'h' THEN high ELSE track END x2, CASE WHEN o = 'h' THEN track ELSE high END y2 FROM last WHERE high-low >= 6""")
def _(fx):
    # The lines on a page a sixteenth as large, so that many share a track.
    return tracks.sweep_collinear(_shrunk(fx.lines, 16))


CROWDED = """WITH RECURSIVE crowded AS (SELECT t.drawing_id, text_id, CAST(floor(x1/8) AS BIGINT)*6 x1,
  CAST(floor(y1/24) AS BIGINT)*14 y1, CAST(floor(x1/8) AS BIGINT)*6+x2-x1 x2, CAST(floor(y1/24) AS BIGINT)*14+y2-y1 y2,
  regexp_replace(trim("text"), '\\s+', ' ', 'g') t, "text" raw, score, width w
  FROM texts_v t JOIN drawings_v d ON t.drawing_id = d.drawing_id),"""
ROWS = sw.walk("rowed", "crowded", "drawing_id", sw.TEXT_FIELDS, "y1, x1, text_id", sw.rows_join, sw.rows_union,
               resort=sw.READING)
TEXT_ITEM = 'drawing_id, o.id text_id, o.x1 x1, o.y1 y1, o.x2 x2, o.y2 y2, o.t "text", o.s score'


def _blocks(source: str, fields: str = sw.TEXT_FIELDS, order: str = "y1, x1, text_id") -> str:
    return sw.walk("blocked", source, "drawing_id", fields, order, sw.blocks_join, sw.blocks_union, resort=sw.READING)


@query("it_merge_close_text", CROWDED.replace("/24", "/120") + sw.walk(
    "closed", "crowded", "drawing_id", sw.TEXT_FIELDS.replace("'t': t", "'t': raw"), "y1, x1, text_id",
    sw.close_join, sw.close_union, passes=False) + f" SELECT {TEXT_ITEM} FROM closed")
def _(fx):
    return folds.merge_close_texts(_crowded(fx.texts, 120)).select("drawing_id", "text_id", *PLACE, "text", "score")


@query("it_merge_horiz", CROWDED + ROWS + f" SELECT {TEXT_ITEM} FROM rowed")
def _(fx):
    merged = folds.merge_horizontal(_crowded(fx.texts), fx.drawings)
    return merged.select("drawing_id", "text_id", *PLACE, "text", "score")


@query("it_merge_vert", CROWDED + _blocks("crowded") + f" SELECT {TEXT_ITEM} FROM blocked")
def _(fx):
    merged = folds.merge_vertical(_crowded(fx.texts), fx.drawings)
    return merged.select("drawing_id", "text_id", *PLACE, "text", "score")


@query("it_merge_text", CROWDED + ROWS + "," + _blocks(
    "rowed", "'id': o.id, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2, 't': o.t, 's': o.s", "o.y1, o.x1, o.id")
    + f""" SELECT {TEXT_ITEM} FROM blocked WHERE NOT (trim(o.t) = '' OR (length(trim(o.t)) = 1
 AND NOT regexp_matches(trim(o.t), '[A-Za-z0-9]')) OR ((o.x2-o.x1)*(o.y2-o.y1) < 120 AND o.s < 0.5))""")
def _(fx):
    return folds.merge_text_items(_crowded(fx.texts), fx.drawings).select(
        "drawing_id", "text_id", *PLACE, "text", "score")


# Walks the masks of every drawing, best score first, with the list of kept ones. Pixels are kept as
# one number of 32 bits for each strip of a row of pixels.
MASKS = f"""
WITH RECURSIVE pieces AS (SELECT drawing_id, mask_id, y, x_start, x_end, unnest(range(x_start//32, (x_end-1)//32 + 1)) s
  FROM runs_v WHERE x_end > x_start),
strips AS (SELECT drawing_id, mask_id, y*65536+s k, bit_or((1::BIGINT << least(x_end-32*s, 32)::INTEGER)
  - (1::BIGINT << greatest(x_start-32*s, 0)::INTEGER)) b FROM pieces GROUP BY ALL),
shapes AS (SELECT drawing_id, mask_id, list({{'k': k, 'b': b}} ORDER BY k) px FROM strips GROUP BY ALL),
boxes AS (SELECT drawing_id, mask_id, min(x_start) x1, min(y) y1, max(x_end) x2, max(y)+1 y2, sum(x_end-x_start)::BIGINT area
  FROM runs_v WHERE x_end > x_start GROUP BY ALL),
m AS (SELECT b.*, px, score, row_number() OVER (PARTITION BY drawing_id ORDER BY score DESC, mask_id) rn
  FROM boxes b JOIN shapes USING (drawing_id, mask_id) JOIN dets_v d ON d.drawing_id = b.drawing_id AND d.det_id = b.mask_id),
walk(drawing_id, rn, kept) USING KEY (drawing_id) AS (
 SELECT DISTINCT drawing_id, 0::BIGINT, [{{'id': 0::BIGINT, 'x1': 0::BIGINT, 'y1': 0::BIGINT, 'x2': 0::BIGINT, 'y2': 0::BIGINT,
  'area': 0::BIGINT, 'score': 0::DOUBLE, 'n': 0::BIGINT, 'px': [{{'k': 0::BIGINT, 'b': 0::BIGINT}}]}}][1:0] FROM m
 UNION
 SELECT drawing_id, rn, CASE WHEN hit IS NULL
   THEN list_append(kept, {{'id': mask_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'area': area, 'score': score, 'n': 1::BIGINT, 'px': px}})
   ELSE list_transform(kept, lambda k, i: CASE WHEN i <> hit THEN k ELSE {{'id': k.id, 'x1': least(k.x1, x1), 'y1': least(k.y1, y1),
     'x2': greatest(k.x2, x2), 'y2': greatest(k.y2, y2), 'area': (k.area + area - {sw.shared_pixels('k.px', 'px')})::BIGINT,
     'score': greatest(k.score, score), 'n': k.n + 1, 'px': {sw.united_pixels('k.px', 'px')}}} END) END
 FROM (SELECT r.*, w.kept, list_filter(range(1, len(w.kept)+1), lambda i: {sw.masks_join('w.kept[i]', 'r')})[1] hit
   FROM walk w JOIN m r ON r.drawing_id = w.drawing_id AND r.rn = w.rn + 1) q)
SELECT drawing_id, o.id mask_id, o.x1 x1, o.y1 y1, o.x2 x2, o.y2 y2, o.area area, o.score score, o.n members
FROM (SELECT drawing_id, unnest(kept) o FROM walk)"""


@query("it_merge_masks", MASKS)
def _(fx):
    masks = fx.detections.selectExpr("drawing_id", "det_id mask_id", "score")
    runs = fx.runs
    merged = folds.merge_masks(masks, runs, m.mask_features(runs))
    return merged.select("drawing_id", "mask_id", *PLACE, "area", "score",
                         F.size("members").cast("bigint").alias("members"))


@query("it_merge_segments", """
WITH RECURSIVE l AS (SELECT drawing_id, line_id, x1, y1, x2, y2 FROM lines_v
  WHERE sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) >= 15),""" + DEDUP + "," + sw.walk(
    "merged", "distinct_lines", "drawing_id", sw.LINE_FIELDS, "line_id", sw.segments_join, sw.segments_union) + """
SELECT drawing_id, o.id line_id, o.x1 x1, o.y1 y1, o.x2 x2, o.y2 y2 FROM merged""")
def _(fx):
    return folds.merge_segments(fx.lines)


@query("it_merge_editor_lines", """
WITH RECURSIVE long AS (SELECT *, 0 w FROM lines_v WHERE sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) >= 60),""" + sw.walk(
    "joined", "long", "drawing_id, line_type", sw.LINE_FIELDS + ", 'd': direction", "line_id", sw.editor_join,
    sw.editor_union, passes=False, rescan=True) + """
SELECT drawing_id, o.id line_id, line_type, o.d direction, o.x1 x1, o.y1 y1, o.x2 x2, o.y2 y2 FROM joined""")
def _(fx):
    return folds.merge_editor_lines(fx.lines, min_length=60.0).select(
        "drawing_id", "line_id", "line_type", "direction", *PLACE)

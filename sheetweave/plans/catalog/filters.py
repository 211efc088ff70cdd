"""Filters over boxes, texts, components, masks, lines and ink."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetweave.functions import geometry as g
from sheetweave.functions.geometry import box
from sheetweave.operators import filters as f
from sheetweave.operators import ink as ink_ops
from sheetweave.operators import masks as m
from sheetweave.operators.joining import large
from sheetweave.plans.catalog.registry import query, r6

TEXT = ["drawing_id", "text_id"]
LINE = ["drawing_id", "line_id"]
MASK = ["drawing_id", "mask_id"]


@query("flt_conf", "SELECT drawing_id, det_id, score FROM dets_v WHERE score >= 0.5")
def _(fx):
    return f.confident(fx.detections, 0.5).select("drawing_id", "det_id", "score")


@query("flt_text_valid", r"""
SELECT drawing_id, text_id, "text" FROM texts_v WHERE length(trim("text")) >= 2 AND (x2-x1)*(y2-y1) >= 120
 AND NOT regexp_full_match(trim("text"), '[^\w]+')
 AND (regexp_matches("text", '\d') OR regexp_matches("text", '[A-Z]{2,}'))""")
def _(fx):
    return f.valid_texts(fx.texts).select(*TEXT, "text")


@query("flt_text_box", """
SELECT t.drawing_id, text_id FROM texts_v t JOIN drawings_v d ON t.drawing_id = d.drawing_id
WHERE NOT ((x2-x1 < 28 AND y2-y1 < 14) OR (x2-x1)/greatest(1, y2-y1) > 20 OR (y2-y1)/greatest(1, x2-x1) > 20
 OR (x2-x1)*(y2-y1) > 0.02*(width*0.25)*(height*0.25) OR score < 0.25)""")
def _(fx):
    return f.plausible_text_boxes(fx.texts, fx.drawings, 0.25).select(*TEXT)


@query("flt_text_junk", """
SELECT drawing_id, text_id FROM texts_v WHERE NOT (trim("text") = ''
 OR (length(trim("text")) = 1 AND NOT regexp_matches(trim("text"), '[A-Za-z0-9]'))
 OR ((x2-x1)*(y2-y1) < 120 AND score < 0.5))""")
def _(fx):
    return f.without_junk(fx.texts).select(*TEXT)


@query("flt_text_blank", """
SELECT drawing_id, text_id FROM texts_v WHERE trim(replace("text", '-', ' ')) <> ''""")
def _(fx):
    dashes_blanked = fx.texts.withColumn("text", F.replace("text", F.lit("-"), F.lit(" ")))
    return f.spoken_texts(dashes_blanked).select(*TEXT)


FEATURES = """
WITH features AS (SELECT drawing_id, mask_id, min(x_start) x1, min(y) y1, max(x_end) x2, max(y)+1 y2,
  CAST(sum(x_end-x_start) AS BIGINT) area FROM runs_v WHERE x_end > x_start GROUP BY drawing_id, mask_id)
"""


@query("flt_mask_area", FEATURES + """
SELECT drawing_id, mask_id, area FROM features WHERE area BETWEEN 100 AND 1500""")
def _(fx):
    return f.mask_area_between(m.mask_features(fx.runs), 100, 1500).select(*MASK, "area")


@query("flt_mask_content", """
WITH px AS (SELECT drawing_id, mask_id, y, unnest(range(x_start, x_end)) x FROM runs_v),
v AS (SELECT drawing_id, mask_id, (x*13+y*7+drawing_id*5)%256 v, x, y FROM px),
s AS (SELECT drawing_id, mask_id, count(*) pixels, count(*) FILTER (WHERE v > 240)/count(*) white,
  stddev_pop(v) sd, max(x)+1-min(x) w, max(y)+1-min(y) h FROM v GROUP BY drawing_id, mask_id)
SELECT drawing_id, mask_id, pixels, round(white, 6) white_share, round(sd, 6) std,
 CASE WHEN white > 0.1 THEN 'whitespace'
  WHEN greatest(w, h)/greatest(least(w, h), 1) > 3 AND pixels/greatest(w*h, 1) < 0.97 THEN 'line'
  WHEN sd < 65 THEN 'low_variance' END reason FROM s""")
def _(fx):
    # Limits at which the derived pages have masks of every verdict.
    masks = fx.detections.select("drawing_id", F.col("det_id").alias("mask_id"))
    verdicts = m.content_verdicts(masks, fx.dealt_runs, fx.pixel_rows, 0.1, 0.97, 65.0, 3.0)
    return verdicts.select(*MASK, "pixels", r6("white_share").alias("white_share"),
                           r6("std").alias("std"), "reason")


@query("flt_line_minlen", """
WITH l AS (SELECT drawing_id, line_id, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) len FROM lines_v)
SELECT drawing_id, line_id, len >= 100 shown_in_editor FROM l WHERE len >= 60""")
def _(fx):
    return f.long_enough(fx.lines, 60).select(
        *LINE, (g.segment_length(box()) >= 100).alias("shown_in_editor"))


INK = """
WITH smp AS (SELECT drawing_id, line_id, x1, y1, x2, y2, CAST(i AS BIGINT) i,
  CASE WHEN i = 79 THEN x2 ELSE CAST(trunc(x1+i*((x2-x1)/79.0)) AS BIGINT) END px,
  CASE WHEN i = 79 THEN y2 ELSE CAST(trunc(y1+i*((y2-y1)/79.0)) AS BIGINT) END py
  FROM (SELECT *, unnest(range(0, 80)) i FROM lines_v) q),
ink AS (SELECT DISTINCT drawing_id, px, py FROM samples_v WHERE hit = 1),
looked AS (SELECT s.drawing_id, line_id, i, CASE WHEN k.px IS NULL THEN 0 ELSE 1 END v FROM smp s
  JOIN drawings_v d ON s.drawing_id = d.drawing_id
  LEFT JOIN ink k ON k.drawing_id = s.drawing_id AND k.px = s.px AND k.py = s.py
  WHERE s.px >= 0 AND s.px < d.width AND s.py >= 0 AND s.py < d.height),
flipped AS (SELECT *, lag(v) OVER (PARTITION BY drawing_id, line_id ORDER BY i) pv,
  sum(v) OVER (PARTITION BY drawing_id, line_id ORDER BY i) island FROM looked),
gaps AS (SELECT drawing_id, line_id, max(n) g FROM (SELECT drawing_id, line_id, island,
  count(*) FILTER (WHERE v = 0) n FROM flipped GROUP BY drawing_id, line_id, island) q GROUP BY drawing_id, line_id),
agg AS (SELECT drawing_id, line_id, count(*) n, avg(v) dens,
  count(*) FILTER (WHERE v <> pv) flips FROM flipped GROUP BY drawing_id, line_id),
stats AS (SELECT l.drawing_id, l.line_id, CASE WHEN coalesce(n, 0) < 10 THEN 0.0 ELSE dens END density,
  CASE WHEN coalesce(n, 0) < 10 THEN 999 ELSE g END max_gap,
  CASE WHEN coalesce(n, 0) < 10 THEN 999 ELSE flips END transitions
  FROM lines_v l LEFT JOIN agg a ON l.drawing_id = a.drawing_id AND l.line_id = a.line_id
  LEFT JOIN gaps ON l.drawing_id = gaps.drawing_id AND l.line_id = gaps.line_id)
"""


@query("win_solid_stats", INK + """
SELECT drawing_id, line_id, round(density, 6) density, CAST(max_gap AS BIGINT) max_gap,
 CAST(transitions AS BIGINT) transitions FROM stats""")
def _(fx):
    stats = ink_ops.solid_stats(fx.lines, fx.ink, fx.drawings)
    return stats.withColumn("density", r6("density"))


@query("flt_solid", INK + """
SELECT drawing_id, line_id FROM stats WHERE density >= 0.68 AND max_gap <= 4 AND transitions <= 6""")
def _(fx):
    return ink_ops.solid_lines(fx.lines, fx.ink, fx.drawings).select(*LINE)


ACROSS = """
WITH ln AS (SELECT *, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) len FROM lines_v),
ink AS (SELECT DISTINCT drawing_id, px, py FROM samples_v WHERE hit = 1),
"""


@query("win_band_score", ACROSS + """
smp AS (SELECT drawing_id, line_id, i, b, CASE WHEN i = 79 THEN x2 ELSE x1+i*((x2-x1)/79.0) END sx,
  CASE WHEN i = 79 THEN y2 ELSE y1+i*((y2-y1)/79.0) END sy, (y1-y2)/(len+1e-6) nx, (x2-x1)/(len+1e-6) ny
  FROM (SELECT *, unnest(range(-2, 3)) b FROM (SELECT *, unnest(range(0, 80)) i FROM ln) q) r),
pt AS (SELECT *, CAST(round_even(sx+b*nx, 0) AS BIGINT) px, CAST(round_even(sy+b*ny, 0) AS BIGINT) py FROM smp),
looked AS (SELECT p.drawing_id, line_id, i, b, p.px >= 0 AND p.px < width AND p.py >= 0 AND p.py < height inside,
  k.px IS NOT NULL AND p.px >= 0 AND p.px < width AND p.py >= 0 AND p.py < height hit
  FROM pt p JOIN drawings_v d ON p.drawing_id = d.drawing_id
  LEFT JOIN ink k ON k.drawing_id = p.drawing_id AND k.px = p.px AND k.py = p.py),
fills AS (SELECT drawing_id, line_id, count(*) FILTER (WHERE hit)/greatest(1, count(*) FILTER (WHERE inside)) f
  FROM looked GROUP BY drawing_id, line_id),
mid AS (SELECT drawing_id, line_id, hit, lag(hit) OVER (PARTITION BY drawing_id, line_id ORDER BY i) p
  FROM looked WHERE b = 0)
SELECT f.drawing_id, f.line_id, round(any_value(f.f), 6) fill, count(*) FILTER (WHERE hit <> p) transitions
FROM fills f JOIN mid m ON f.drawing_id = m.drawing_id AND f.line_id = m.line_id GROUP BY f.drawing_id, f.line_id""")
def _(fx):
    scores = ink_ops.band_scores(fx.lines, fx.ink, fx.drawings)
    return scores.withColumn("fill", r6("fill"))


@query("win_sample_hits", ACROSS + """
n AS (SELECT *, greatest(12, CAST(floor(greatest(1, floor(len))) AS BIGINT)) n FROM ln),
smp AS (SELECT drawing_id, line_id, i, b,
  trunc(CASE WHEN i = n-1 THEN x2 ELSE x1+i*((x2-x1)/(n-1)) END) sx,
  trunc(CASE WHEN i = n-1 THEN y2 ELSE y1+i*((y2-y1)/(n-1)) END) sy, (y1-y2)/(len+1e-6) nx, (x2-x1)/(len+1e-6) ny
  FROM (SELECT *, unnest(range(-2, 3)) b FROM (SELECT *, unnest(range(0, n)) i FROM n) q) r),
pt AS (SELECT *, CAST(round_even(sx+b*nx, 0) AS BIGINT) px, CAST(round_even(sy+b*ny, 0) AS BIGINT) py FROM smp),
looked AS (SELECT p.drawing_id, line_id, i,
  max(CASE WHEN k.px IS NOT NULL AND p.px >= 0 AND p.px < width AND p.py >= 0 AND p.py < height THEN 1 ELSE 0 END) v
  FROM pt p JOIN drawings_v d ON p.drawing_id = d.drawing_id
  LEFT JOIN ink k ON k.drawing_id = p.drawing_id AND k.px = p.px AND k.py = p.py GROUP BY p.drawing_id, line_id, i)
SELECT drawing_id, line_id, string_agg(CAST(v AS VARCHAR), '' ORDER BY i) hits FROM looked GROUP BY drawing_id, line_id""")
def _(fx):
    return ink_ops.sample_hits(fx.lines, fx.ink, fx.drawings)


@query("flt_line_cover", """
WITH n AS (SELECT *, greatest(5, CAST(floor(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))/4) AS BIGINT)) n FROM lines_v),
p AS (SELECT drawing_id, line_id, n, x1+(i/n)*(x2-x1) px, y1+(i/n)*(y2-y1) py
  FROM (SELECT *, unnest(range(0, n+1)) i FROM n) q),
b AS (SELECT DISTINCT drawing_id, x1, y1, x2, y2, 0.4 lim FROM texts_v
  UNION SELECT DISTINCT drawing_id, x1, y1, x2, y2, 0.5 FROM symbols_v),
c AS (SELECT p.drawing_id, line_id, x1, y1, x2, y2, lim, count(*)/(any_value(n)+1) share FROM p JOIN b
  ON p.drawing_id = b.drawing_id AND px BETWEEN x1-10 AND x2+10 AND py BETWEEN y1-10 AND y2+10
  GROUP BY p.drawing_id, line_id, x1, y1, x2, y2, lim)
SELECT drawing_id, line_id FROM lines_v l WHERE NOT EXISTS
 (SELECT 1 FROM c WHERE c.drawing_id = l.drawing_id AND c.line_id = l.line_id AND share >= lim)""")
def _(fx):
    return f.uncovered_lines(fx.lines, fx.texts, fx.symbols, text_share=0.4, symbol_share=0.5).select(*LINE)


ERASED = """
WITH ink AS (SELECT DISTINCT drawing_id, py y, px x FROM samples_v WHERE hit = 1)
SELECT drawing_id, y, x x_start, x+1 x_end FROM ink i WHERE NOT EXISTS (SELECT 1 FROM {table} b
 WHERE b.drawing_id = i.drawing_id AND x BETWEEN x1-{pad} AND x2+{pad} AND y BETWEEN y1-{pad} AND y2+{pad})"""


@query("flt_text_suppress", ERASED.format(table="texts_v", pad=4))
def _(fx):
    return ink_ops.erase(fx.ink, fx.texts, 4)


@query("flt_symbol_suppress", ERASED.format(table="symbols_v", pad=0))
def _(fx):
    return ink_ops.erase(fx.ink, fx.symbols, 0)


CONTOURS = """
WITH contours AS (SELECT drawing_id, symbol_id contour_id, x1 x, y1 y, (x2-x1)*12 w, (y2-y1)*10 h,
  4+symbol_id%9 vertices FROM symbols_v),
scored AS (SELECT c.*, width, height, w*h + (CASE WHEN vertices <= 8 THEN 0.25 ELSE 0 END)*(w*h)
  + ((x < 0.08*width)::INT + (y < 0.08*height)::INT + (x+w > 0.92*width)::INT + (y+h > 0.92*height)::INT)*0.10*(w*h) score
  FROM contours c JOIN drawings_v d ON c.drawing_id = d.drawing_id WHERE w*h >= 0.2*width*height),
best AS (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY score DESC, contour_id) rn FROM scored),
frame AS (SELECT drawing_id, contour_id, greatest(x+28, 0) x1, greatest(y+28, 0) y1, least(x+w-28, width) x2,
  least(y+h-28, height) y2 FROM best WHERE rn = 1)
"""


@query("flt_notes_frame", CONTOURS + """,
ink AS (SELECT DISTINCT drawing_id, py y, px x FROM samples_v WHERE hit = 1)
SELECT i.drawing_id, y, x x_start, x+1 x_end FROM ink i JOIN drawings_v d ON i.drawing_id = d.drawing_id
LEFT JOIN frame fr ON fr.drawing_id = i.drawing_id
WHERE x < CAST(trunc(width*0.78) AS BIGINT) AND x >= coalesce(x1, 0) AND x < coalesce(x2, width)
 AND y >= coalesce(y1, 0) AND y < coalesce(y2, height)""")
def _(fx):
    contours = fx.symbols.selectExpr("drawing_id", "symbol_id contour_id", "x1 x", "y1 y",
                                     "(x2-x1)*12 w", "(y2-y1)*10 h", "4+symbol_id%9 vertices")
    frames = ink_ops.choose_frame(contours, fx.drawings)
    return ink_ops.keep_area(fx.ink, fx.drawings, frames)


COMPONENTS = """
WITH comp AS (SELECT drawing_id, symbol_id, x1 x, y1 y, x2-x1 w, y2-y1 h,
  CAST(floor((x2-x1)*(y2-y1)*(20+symbol_id%80)/100) AS BIGINT) area FROM symbols_v)
"""


def _components(fx):
    return fx.symbols.selectExpr(
        "drawing_id", "symbol_id", "x1 x", "y1 y", "x2-x1 w", "y2-y1 h",
        "CAST(floor((x2-x1)*(y2-y1)*(20+symbol_id%80)/100) AS BIGINT) area")


@query("flt_component_seg", COMPONENTS + """
SELECT drawing_id, symbol_id, CASE WHEN symbol_id%2=0 THEN x ELSE CAST(trunc(x+w/2) AS BIGINT) END x1,
 CASE WHEN symbol_id%2=0 THEN CAST(trunc(y+h/2) AS BIGINT) ELSE y END y1,
 CASE WHEN symbol_id%2=0 THEN x+w ELSE CAST(trunc(x+w/2) AS BIGINT) END x2,
 CASE WHEN symbol_id%2=0 THEN CAST(trunc(y+h/2) AS BIGINT) ELSE y+h END y2
FROM comp WHERE area >= 6 AND CASE WHEN symbol_id%2=0 THEN w ELSE h END >= 12""")
def _(fx):
    flat = F.when(F.col("symbol_id") % 2 == 0, "h").otherwise("v")
    return (f.component_segments(_components(fx), flat)
            .select("drawing_id", "symbol_id", "x1", "y1", "x2", "y2"))


@query("flt_symbol_contour", COMPONENTS + """
SELECT drawing_id, symbol_id, x-4 x1, y-4 y1, x+w+6 x2, y+h+6 y2 FROM comp
WHERE w*h >= 600 AND greatest(w, h) <= 260 AND greatest(w, h)/(least(w, h)+1e-6) <= 2.8""")
def _(fx):
    return f.symbol_contours(_components(fx)).select("drawing_id", "symbol_id", "x1", "y1", "x2", "y2")


@query("flt_symbol_box", COMPONENTS + """
SELECT c.drawing_id, symbol_id, x x1, y y1, x+w x2, y+h y2 FROM comp c JOIN drawings_v d
ON c.drawing_id = d.drawing_id WHERE area BETWEEN 60 AND 2000 AND NOT (w > 0.8*width OR h > 0.8*height)""")
def _(fx):
    return (f.symbol_boxes(_components(fx), fx.drawings, max_area=2000)
            .selectExpr("drawing_id", "symbol_id", "x x1", "y y1", "x+w x2", "y+h y2"))


@query("flt_blob_remove", FEATURES + """,
chosen AS (SELECT * FROM features WHERE area >= 1200 AND mask_id%5 <> 0
  AND greatest(x2-x1, y2-y1)/greatest(1, least(x2-x1, y2-y1)) <= 2.2
  AND greatest(x2-x1, y2-y1) <= 220 AND area/greatest(1, (x2-x1)*(y2-y1)) >= 0.25),
px AS (SELECT drawing_id, mask_id, y, unnest(range(x_start, x_end)) x FROM runs_v),
e AS (SELECT c.drawing_id, c.mask_id, any_value(area) area, greatest(count(*) FILTER (WHERE y < y1+2),
  count(*) FILTER (WHERE y >= y2-2), count(*) FILTER (WHERE x < x1+2), count(*) FILTER (WHERE x >= x2-2)) touch
  FROM chosen c JOIN px p ON c.drawing_id = p.drawing_id AND c.mask_id = p.mask_id GROUP BY c.drawing_id, c.mask_id)
SELECT drawing_id, mask_id FROM features f WHERE NOT EXISTS
 (SELECT 1 FROM e WHERE e.drawing_id = f.drawing_id AND e.mask_id = f.mask_id AND touch/greatest(1, area) <= 0.10)""")
def _(fx):
    runs = fx.runs
    features = m.mask_features(runs)
    blobs = f.compact_blobs(features.withColumn("has_long_line", F.expr("mask_id % 5 = 0")), runs)
    return features.select(*MASK).join(large(blobs.select(*MASK)), MASK, "left_anti")


PATTERNS = """
WITH pat AS (SELECT unnest(['text','txt','label','annotation','line','lines','pipe','pipes','piping','connector',
 'connection','border','frame','title','heading','noise','background','other','unknown']) p),
lab AS (SELECT drawing_id, symbol_id, CASE symbol_id%8 WHEN 0 THEN 'Pipe Valve' WHEN 1 THEN 'unlabeled' WHEN 2 THEN ''
 WHEN 3 THEN ' Ann' WHEN 4 THEN 'pump' WHEN 5 THEN 'TEXT box' WHEN 6 THEN 'other' ELSE category END category FROM symbols_v)
"""


def labelled(fx):
    """Symbols with labels of every kind, kept and discarded ones."""
    return fx.symbols.withColumn("category", F.expr(
        "CASE symbol_id%8 WHEN 0 THEN 'Pipe Valve' WHEN 1 THEN 'unlabeled' WHEN 2 THEN ''"
        " WHEN 3 THEN ' Ann' WHEN 4 THEN 'pump' WHEN 5 THEN 'TEXT box' WHEN 6 THEN 'other'"
        " ELSE category END"))


@query("flt_discard_cat", PATTERNS + """
SELECT drawing_id, symbol_id, category, category <> '' AND EXISTS (SELECT 1 FROM pat
 WHERE contains(trim(lower(category)), p) OR contains(p, trim(lower(category)))) discarded FROM lab""")
def _(fx):
    return f.discard_split(labelled(fx)).select("drawing_id", "symbol_id", "category", "discarded")


@query("flt_list_search", """
WITH r AS (SELECT drawing_id, det_id, printf('#%3d | Score: %.3f | Area: %5dpx', det_id, score, (x2-x1)*(y2-y1)) shown
 FROM dets_v)
SELECT * FROM r WHERE contains(lower(shown), 'score: 0.9')""")
def _(fx):
    shown = F.format_string("#%3d | Score: %.3f | Area: %5dpx", "det_id", "score", g.area(box()))
    return f.list_search(fx.detections, shown, "Score: 0.9").select("drawing_id", "det_id", "shown")

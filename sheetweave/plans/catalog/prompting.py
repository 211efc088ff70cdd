"""Prompts, tiles, splits, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetweave.operators import clusters as cl
from sheetweave.operators import prompts as p
from sheetweave.plans.catalog.registry import query, r6


@query("gen_grid_points", """
WITH n AS (SELECT drawing_id, width, height, iy, unnest(range(0, 32)) ix FROM
 (SELECT *, unnest(range(0, 32)) iy FROM drawings_v) q)
SELECT drawing_id, iy*32+ix idx, CASE WHEN ix = 31 THEN width-1 ELSE CAST(trunc(ix*((width-1)/31.0)) AS BIGINT) END x,
 CASE WHEN iy = 31 THEN height-1 ELSE CAST(trunc(iy*((height-1)/31.0)) AS BIGINT) END y FROM n""")
def _(fx):
    return p.grid_points(fx.drawings)


@query("gen_grid_boxes", """
WITH n AS (SELECT *, unnest(range(0, 3)) iz FROM (SELECT *, unnest(range(0, 16)) iy FROM
 (SELECT *, unnest(range(0, 16)) ix FROM drawings_v) q) r),
c AS (SELECT drawing_id, width, height, (ix*16+iy)*3+iz idx,
 CASE WHEN ix = 15 THEN width-20 ELSE CAST(trunc(20+ix*((width-40)/15.0)) AS BIGINT) END cx,
 CASE WHEN iy = 15 THEN height-20 ELSE CAST(trunc(20+iy*((height-40)/15.0)) AS BIGINT) END cy,
 CASE iz WHEN 0 THEN 10 WHEN 1 THEN 55 ELSE 100 END half FROM n)
SELECT drawing_id, idx, greatest(0, cx-half) x1, greatest(0, cy-half) y1, least(width, cx+half) x2, least(height, cy+half) y2 FROM c""")
def _(fx):
    return p.grid_boxes(fx.drawings)


@query("it_tile_windows", """
WITH y AS (SELECT drawing_id, width, y FROM (SELECT *, unnest(range(0, greatest(1, height-500+1), 350)) y FROM drawings_v) q
 UNION SELECT drawing_id, width, height-500 FROM drawings_v
 WHERE height > 500 AND CAST(floor((height-500)/350) AS BIGINT)*350+500 < height),
x AS (SELECT drawing_id, y, x FROM (SELECT *, unnest(range(0, greatest(1, width-500+1), 350)) x FROM y) q
 UNION SELECT drawing_id, y, width-500 FROM y WHERE width > 500 AND CAST(floor((width-500)/350) AS BIGINT)*350+500 < width)
SELECT drawing_id, x, y, 500::BIGINT w, 500::BIGINT h FROM x""")
def _(fx):
    return p.tiles(fx.drawings, 500, 350)


@query("gen_center_prompts", """
SELECT drawing_id, symbol_id, (x1+x2)/2.0 x, (y1+y2)/2.0 y, 1::BIGINT label FROM symbols_v""")
def _(fx):
    return p.center_prompts(fx.symbols)


CHANCE = "(CAST('0x' || substr(md5(concat_ws('-', s.drawing_id, symbol_id, i, '{}', 42)), 1, 13) AS BIGINT)/4503599627370496.0)"
NEGATIVES = """
WITH px AS (SELECT DISTINCT drawing_id, y, unnest(range(x_start, x_end)) x FROM runs_v),
c AS (SELECT s.drawing_id, symbol_id, i, width, height,
  (x1+x2)/2.0+greatest(x2-x1, y2-y1)*(1.2+2.8*""" + CHANCE.format("d") + """)*cos(2*pi()*""" + CHANCE.format("a") + """) x,
  (y1+y2)/2.0+greatest(x2-x1, y2-y1)*(1.2+2.8*""" + CHANCE.format("d") + """)*sin(2*pi()*""" + CHANCE.format("a") + """) y
  FROM (SELECT *, unnest(range(0, 40)) i FROM symbols_v) s JOIN drawings_v d ON s.drawing_id = d.drawing_id),
f AS (SELECT drawing_id, symbol_id, i, CAST(trunc(x) AS BIGINT) x, CAST(trunc(y) AS BIGINT) y FROM c
  WHERE x >= 0 AND x < width AND y >= 0 AND y < height),
g AS (SELECT f.*, row_number() OVER (PARTITION BY drawing_id, symbol_id ORDER BY i) - 1 place,
  count(*) OVER (PARTITION BY drawing_id, symbol_id) n FROM f ANTI JOIN px USING (drawing_id, y, x)),
good AS (SELECT drawing_id, symbol_id, place, x::DOUBLE x, y::DOUBLE y FROM g WHERE n >= 2 AND place < 2),
rim AS (SELECT drawing_id, i, x::DOUBLE x, y::DOUBLE y FROM drawings_v, LATERAL (VALUES (0, width*0.1, height*0.1),
  (1, width*0.9, height*0.1), (2, width*0.1, height*0.9), (3, width*0.9, height*0.9), (4, width*0.5, 0),
  (5, width*0.5, height-1), (6, 0, height*0.5), (7, width-1, height*0.5)) v(i, x, y)),
spare AS (SELECT drawing_id, x, y, row_number() OVER (PARTITION BY drawing_id ORDER BY i) - 1 place FROM rim r
  WHERE NOT EXISTS (SELECT 1 FROM px WHERE px.drawing_id = r.drawing_id AND px.x = trunc(r.x) AND px.y = trunc(r.y))),
lack AS (SELECT drawing_id, symbol_id, unnest([0, 1]) place FROM symbols_v ANTI JOIN good USING (drawing_id, symbol_id)),
negatives AS (SELECT * FROM good UNION ALL SELECT l.drawing_id, symbol_id, l.place,
  coalesce(s.x, floor(width/4)), coalesce(s.y, floor(height/4)) FROM lack l JOIN drawings_v d ON l.drawing_id = d.drawing_id
  LEFT JOIN spare s ON s.drawing_id = l.drawing_id AND s.place = l.place)
"""


@query("gen_negatives", NEGATIVES + """
SELECT drawing_id, symbol_id, CAST(place AS BIGINT) place, round(x, 6) x, round(y, 6) y FROM negatives""")
def _(fx):
    points = p.negative_points(fx.symbols, fx.drawings, fx.runs)
    return points.select("drawing_id", "symbol_id", F.col("place").cast("bigint").alias("place"),
                         r6("x").alias("x"), r6("y").alias("y"))


@query("chk_negatives", """
WITH pts AS (SELECT drawing_id, CAST(trunc((x1+x2)/2.0+symbol_id%40) AS BIGINT) x, CAST(trunc((y1+y2)/2.0) AS BIGINT) y FROM symbols_v),
px AS (SELECT DISTINCT drawing_id, y, unnest(range(x_start, x_end)) x FROM runs_v)
SELECT p.drawing_id, count(*) points, count(px.x) on_mask FROM pts p LEFT JOIN px
 ON px.drawing_id = p.drawing_id AND px.x = p.x AND px.y = p.y GROUP BY p.drawing_id""")
def _(fx):
    points = fx.symbols.selectExpr("drawing_id", "(x1+x2)/2 + symbol_id%40 x", "(y1+y2)/2 y")
    return p.count_on_masks(points, fx.runs)


SHUFFLED = """
WITH o AS (SELECT drawing_id, row_number() OVER (ORDER BY md5(concat_ws('-', drawing_id, 42)), drawing_id) - 1 place,
  count(*) OVER () n FROM drawings_v)
"""


@query("gen_split", SHUFFLED + """
SELECT drawing_id, CASE WHEN place < CAST(trunc(n*0.9) AS BIGINT) THEN 'train' ELSE 'val' END split FROM o""")
def _(fx):
    return p.split(fx.drawings)


@query("gen_max_samples", SHUFFLED + "SELECT drawing_id FROM o WHERE place < 7")
def _(fx):
    # The limit is the operator itself.
    return p.sample(fx.drawings, 7)


@query("emb_normalize", """
WITH e AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE)))+1e-8 n FROM embeddings)
SELECT vec_id, round(embedding[1]::DOUBLE/n, 6) first, round(embedding[64]::DOUBLE/n, 6) last,
 round(list_sum(list_transform(embedding, lambda x: x::DOUBLE/n)), 6) total FROM e""")
def _(fx):
    unit = fx.embeddings.select("vec_id", cl.normalised(F.col("embedding")).alias("u"))
    return unit.select("vec_id", r6(F.element_at("u", 1)).alias("first"), r6(F.element_at("u", 64)).alias("last"),
                       r6(F.aggregate("u", F.lit(0.0), lambda s, x: s + x)).alias("total"))


def _unit(fx):
    return fx.embeddings.select("vec_id", cl.normalised(F.col("embedding")).alias("embedding"))


@query("clu_kmeans")
def _(fx):
    return cl.kmeans(_unit(fx), "embedding", k=8, restarts=10).select("vec_id", "cluster_id")


@query("clu_elbow")
def _(fx):
    rows = _unit(fx)
    ks = range(2, cl.largest_k(rows.count()) + 1)
    return cl.elbow(cl.inertias(rows, "embedding", ks, restarts=3))


@query("clu_by_sensitivity")
def _(fx):
    return cl.cluster(_unit(fx), "embedding", "low").select("vec_id", "cluster_id")


@query("clu_elbow_of_costs", """
WITH c AS (SELECT drawing_id k, (10000.0/(drawing_id+1) + (drawing_id*7919)%101)::DOUBLE inertia FROM (SELECT DISTINCT drawing_id FROM symbols_v) q),
b AS (SELECT k, lead(inertia, 2) OVER (ORDER BY k) - 2*lead(inertia) OVER (ORDER BY k) + inertia bend FROM c)
SELECT CASE WHEN count(*) >= 3 THEN arg_max(k, {'b': coalesce(bend, -1e300), 'k': -k}) + 2 ELSE max(k) END k FROM b""")
def _(fx):
    costs = fx.symbols.select("drawing_id").distinct().selectExpr(
        "drawing_id k", "CAST(10000.0D/(drawing_id+1) + (drawing_id*7919)%101 AS DOUBLE) inertia")
    return cl.elbow(costs)


@query("clu_density")
def _(fx):
    flat = cl.pca2d(_unit(fx), "embedding").select("vec_id", "px", "py")
    size, need = cl.density_parameters(flat.count())
    return cl.density_clusters(flat, "vec_id", 0.03, need, size).select("vec_id", "cluster_id")


@query("clu_pca2d")
def _(fx):
    return cl.pca2d(_unit(fx), "embedding").select("vec_id", r6("px").alias("px"), r6("py").alias("py"))


@query("clu_edit", """
WITH moves AS (SELECT seq, (seq*7)%(SELECT max(vec_id)+1 FROM clusters_v) vec_id, CASE WHEN seq%50 = 0 THEN NULL ELSE seq%5 END target FROM edits_v WHERE seq%3 = 0),
opened AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 nth FROM moves WHERE target IS NULL),
g AS (SELECT m.seq, vec_id, coalesce(target, (SELECT max(cluster_id) FROM clusters_v)+1+nth) t FROM moves m LEFT JOIN opened USING (seq)),
l AS (SELECT vec_id, arg_max(t, seq) t FROM g GROUP BY vec_id)
SELECT c.vec_id, coalesce(t, cluster_id) cluster_id FROM clusters_v c LEFT JOIN l ON l.vec_id = c.vec_id""")
def _(fx):
    size = fx.clusters.agg(F.max("vec_id") + 1).first()[0]
    moves = fx.edits.where("seq % 3 = 0").selectExpr(
        "seq", f"(seq*7)%{size} vec_id", "IF(seq%50 = 0, NULL, seq%5) target")
    return cl.move_rows(fx.clusters, moves, "vec_id").select("vec_id", "cluster_id")

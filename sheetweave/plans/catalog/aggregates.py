"""Aggregations, orderings, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetweave.functions import geometry as g
from sheetweave.functions.geometry import box
from sheetweave.operators import aggregates as ag
from sheetweave.operators import filters as f
from sheetweave.operators import graph, masks as m
from sheetweave.operators.ordering import with_position
from sheetweave.plans.catalog.filters import FEATURES, PATTERNS, labelled
from sheetweave.plans.catalog.joins import ASSIGNED, BY_FIVE, BY_LINE, chains_of_five, own_chains
from sheetweave.plans.catalog.registry import query, r6
from sheetweave.scratch import Scratch

MASK = ["drawing_id", "mask_id"]


@query("agg_mask_bbox", FEATURES + """,
listed AS (SELECT drawing_id, det_id mask_id FROM dets_v UNION ALL
  SELECT drawing_id, 1000 + drawing_id FROM drawings_v)
SELECT l.drawing_id, l.mask_id, coalesce(x1, 0) x1, coalesce(y1, 0) y1, coalesce(x2, 0) x2, coalesce(y2, 0) y2,
 coalesce(area, 0) area FROM listed l LEFT JOIN features f ON l.drawing_id = f.drawing_id AND l.mask_id = f.mask_id""")
def _(fx):
    # One mask per drawing has no pixel at all.
    listed = fx.detections.selectExpr("drawing_id", "det_id mask_id").unionByName(
        fx.drawings.selectExpr("drawing_id", "1000 + drawing_id mask_id"))
    return m.features_of_all(listed, fx.runs)


@query("agg_union_masks", """
WITH px AS (SELECT DISTINCT drawing_id, CAST(floor(mask_id/3) AS BIGINT) group_id, y, unnest(range(x_start, x_end)) x
  FROM runs_v),
sc AS (SELECT drawing_id, CAST(floor(det_id/3) AS BIGINT) group_id, avg(score) mean_score, max(score) best_score
  FROM dets_v GROUP BY drawing_id, floor(det_id/3))
SELECT p.drawing_id, p.group_id, min(x) x1, min(y) y1, max(x)+1 x2, max(y)+1 y2, count(*) area,
 round(any_value(mean_score), 6) mean_score, any_value(best_score) best_score
FROM px p JOIN sc ON p.drawing_id = sc.drawing_id AND p.group_id = sc.group_id GROUP BY p.drawing_id, p.group_id""")
def _(fx):
    masks = fx.detections.selectExpr("drawing_id", "det_id mask_id", "score",
                                     "CAST(floor(det_id/3) AS BIGINT) group_id")
    _, features = m.union_masks(fx.runs, masks, "group_id")
    return features.select("drawing_id", "group_id", "x1", "y1", "x2", "y2", "area",
                           r6("mean_score").alias("mean_score"), "best_score")


@query("agg_coord_mean", """
WITH s AS (SELECT drawing_id, avg((x1+y1+x2+y2)/4.0) symbol_mean FROM symbols_v GROUP BY drawing_id),
l AS (SELECT drawing_id, avg((x1+y1+x2+y2)/4.0) line_mean FROM
  (SELECT * FROM lines_v QUALIFY row_number() OVER (PARTITION BY drawing_id ORDER BY line_id) <= 10) GROUP BY drawing_id)
SELECT s.drawing_id, round(symbol_mean, 6) symbol_mean, round(line_mean, 6) line_mean
FROM s LEFT JOIN l ON l.drawing_id = s.drawing_id""")
def _(fx):
    mean = F.expr("(x1+y1+x2+y2)/4")
    symbols = fx.symbols.groupBy("drawing_id").agg(r6(F.avg(mean)).alias("symbol_mean"))
    lines = (graph.first_lines(fx.lines).groupBy("drawing_id")
             .agg(r6(F.avg(mean)).alias("line_mean")))
    return symbols.join(lines, "drawing_id", "left")


LINKS = "WITH " + BY_LINE + """,
kept AS (SELECT h.*, line_type, direction, x1, y1, x2, y2, len, row_number() OVER (PARTITION BY h.drawing_id, chain_id
  ORDER BY pos, first_member, symbol_id) - 1 k FROM hits h JOIN members mm USING (drawing_id, chain_id)),
steps AS (SELECT *, lead(symbol_id) OVER w nxt, lead(distance) OVER w nd FROM kept
  WINDOW w AS (PARTITION BY drawing_id, chain_id ORDER BY k)),
links AS (SELECT drawing_id, chain_id, k, CASE WHEN direction = 'backward' THEN nxt ELSE symbol_id END source,
  CASE WHEN direction = 'backward' THEN symbol_id ELSE nxt END target, line_type "type",
  CASE WHEN direction = 'backward' THEN 'forward' ELSE direction END direction, direction used,
  distance sd, nd td, x1, y1, x2, y2, len FROM steps WHERE nxt IS NOT NULL AND nxt <> symbol_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY drawing_id, least(source, target), greatest(source, target)
  ORDER BY chain_id, k) rn FROM links),
deduped AS (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY chain_id, k) - 1 link_id
  FROM ranked WHERE rn = 1)
"""


def _own_links(fx):
    return graph.chain_links(own_chains(fx), fx.symbols, 50.0)


@query("agg_metadata", LINKS + """,
per AS (SELECT drawing_id, chain_id, count(*) n FROM hits GROUP BY drawing_id, chain_id)
SELECT d.drawing_id, (SELECT count(*) FROM symbols_v s WHERE s.drawing_id = d.drawing_id) total_symbols,
 (SELECT count(*) FROM deduped s WHERE s.drawing_id = d.drawing_id) total_connections,
 (SELECT count(*) FROM deduped s WHERE s.drawing_id = d.drawing_id) full_connections,
 (SELECT count(*) FROM texts_v s WHERE s.drawing_id = d.drawing_id) total_text_detections,
 (SELECT count(*) FROM lines_v s WHERE s.drawing_id = d.drawing_id) total_lines,
 (SELECT count(*) FROM lines_v s WHERE s.drawing_id = d.drawing_id AND direction <> 'none') lines_with_direction,
 (SELECT count(*) FROM lines_v s WHERE s.drawing_id = d.drawing_id)
 - (SELECT count(*) FROM per WHERE per.drawing_id = d.drawing_id AND n >= 2) skipped_no_partial_connection,
 CAST(0 AS BIGINT) skipped_self_loops FROM drawings_v d""")
def _(fx):
    members = own_chains(fx)
    hits = Scratch(fx.spark).save(graph.chain_hits(members, fx.symbols, 50.0))  # links and three counters read them
    links = graph.first_per_pair(graph.link_hits(hits, members, 50.0))
    nodes = fx.symbols.withColumn("page", F.lit(0))
    return graph.metadata(nodes, links, fx.texts, fx.lines, hits, members, fx.drawings)


@query("agg_captions", "WITH " + ASSIGNED + """
SELECT drawing_id, symbol_id, CAST(0 AS BIGINT) page, count(*) n,
 string_agg("text", ' | ' ORDER BY dist, text_id) captions, round(max(dist), 6) furthest
FROM assigned GROUP BY drawing_id, symbol_id""")
def _(fx):
    pages = graph.caption_pages(graph.assign_texts(fx.texts, fx.symbols))
    return pages.select("drawing_id", "symbol_id", "page", F.size("captions").cast("bigint").alias("n"),
                        F.array_join("captions", " | ").alias("captions"),
                        r6(F.array_max(F.transform("nearby", lambda d: d["distance"]))).alias("furthest"))


CHAIN_AGG = """
WITH c AS (SELECT *, CAST(floor(line_id/5) AS BIGINT) chain_id, line_id%5 pos FROM lines_v)
"""


@query("agg_chain_dir", CHAIN_AGG + """
SELECT drawing_id, chain_id, coalesce(arg_min(direction, pos) FILTER (WHERE direction <> 'none'), 'none') direction
FROM c GROUP BY drawing_id, chain_id""")
def _(fx):
    return graph.chain_summary(chains_of_five(fx)).select("drawing_id", "chain_id", "direction")


@query("agg_link_line", CHAIN_AGG + """,
e AS (SELECT drawing_id, chain_id, arg_min(x1, pos) x1, arg_min(y1, pos) y1, arg_max(x2, pos) x2, arg_max(y2, pos) y2
  FROM c GROUP BY drawing_id, chain_id)
SELECT *, round(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)), 6) length FROM e""")
def _(fx):
    return graph.chain_summary(chains_of_five(fx)).select(
        "drawing_id", "chain_id", "x1", "y1", "x2", "y2", r6("length").alias("length"))


@query("agg_link_quality", LINKS + """
SELECT drawing_id, chain_id, k, round(sd, 6) source_distance, round(td, 6) target_distance, 'full' connection_type,
 used direction_used, round(greatest(0.0, 1-sd/50.0), 6) source_confidence,
 round(greatest(0.0, 1-td/50.0), 6) target_confidence FROM links""")
def _(fx):
    flat = _own_links(fx).select("drawing_id", "chain_id", "k", "quality.*")
    return flat.withColumns({c: r6(c) for c in flat.columns
                             if c.endswith("_distance") or c.endswith("_confidence")})


@query("agg_category_counts", PATTERNS + """,
c AS (SELECT drawing_id, category, count(*) n FROM lab GROUP BY drawing_id, category),
k AS (SELECT drawing_id, count(DISTINCT symbol_id%9-1) FILTER (WHERE symbol_id%9-1 >= 0) num_clusters
  FROM symbols_v GROUP BY drawing_id)
SELECT c.drawing_id, category, n, category <> '' AND EXISTS (SELECT 1 FROM pat
 WHERE contains(trim(lower(category)), p) OR contains(p, trim(lower(category)))) discarded, num_clusters
FROM c JOIN k ON c.drawing_id = k.drawing_id""")
def _(fx):
    clustered = fx.symbols.withColumn("cluster_id", F.expr("symbol_id%9-1"))
    return ag.category_counts(labelled(fx)).join(ag.count_clusters(clustered), "drawing_id")


NOISY = "WITH noisy AS (SELECT vec_id, CASE WHEN vec_id%11 = 0 THEN -1 ELSE cluster_id END cluster_id FROM clusters_v)"


def noisy_clusters(fx):
    return fx.clusters.withColumn("cluster_id", F.expr("IF(vec_id%11 = 0, -1L, cluster_id)"))


@query("agg_cluster_dist", NOISY + """
SELECT cluster_id, count(*) n, round(count(*)/(SELECT count(*) FROM noisy), 6) share FROM noisy GROUP BY cluster_id""")
def _(fx):
    return ag.cluster_sizes(noisy_clusters(fx)).withColumn("share", r6("share"))


@query("agg_top_categories", """
WITH c AS (SELECT drawing_id, category, count(*) n FROM symbols_v GROUP BY drawing_id, category)
SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY n DESC, category) - 1 place FROM c""")
def _(fx):
    return ag.top_categories(fx.symbols)


@query("agg_extent", """
WITH a AS (SELECT drawing_id, x2 x, y2 y FROM symbols_v UNION ALL SELECT drawing_id, greatest(x1, x2), greatest(y1, y2) FROM lines_v
 UNION ALL SELECT drawing_id, x2, y2 FROM texts_v),
e AS (SELECT drawing_id, greatest(0, max(x)) max_x, greatest(0, max(y)) max_y FROM a GROUP BY drawing_id)
SELECT e.drawing_id, max_x, max_y, max_x > width*1.1 OR max_y > height*1.1 space_larger,
 (max_x < width*0.5 OR max_y < height*0.5) AND NOT (max_x > width*1.1 OR max_y > height*1.1) space_smaller
FROM e JOIN drawings_v d ON e.drawing_id = d.drawing_id""")
def _(fx):
    return ag.extents(fx.symbols, fx.lines, fx.texts, fx.drawings)


@query("agg_score_stats", """
SELECT drawing_id, CAST(floor(det_id/64) AS BIGINT) batch, min(score) low, max(score) high,
 count(*) FILTER (WHERE score >= 0.5) above FROM dets_v GROUP BY drawing_id, floor(det_id/64)""")
def _(fx):
    return ag.score_stats(fx.detections)


@query("agg_area_stats", FEATURES + """
SELECT drawing_id, min(area) low, max(area) high, round(avg(area), 6) mean FROM features GROUP BY drawing_id""")
def _(fx):
    return ag.area_stats(m.mask_features(fx.runs)).withColumn("mean", r6("mean"))


@query("agg_split_counts", """
WITH sp AS (SELECT drawing_id, CASE WHEN drawing_id%10 < 9 THEN 'train' ELSE 'val' END split FROM drawings_v),
n AS (SELECT drawing_id, count(*) n FROM symbols_v GROUP BY drawing_id)
SELECT split, count(*) images, CAST(sum(n) AS BIGINT) symbols FROM sp JOIN n ON sp.drawing_id = n.drawing_id GROUP BY split""")
def _(fx):
    splits = fx.drawings.selectExpr("drawing_id", "IF(drawing_id%10 < 9, 'train', 'val') split")
    return ag.split_counts(fx.symbols, splits)


@query("agg_mask_eval", """
WITH p AS (SELECT drawing_id, CAST(floor(mask_id/3)*2 + mask_id%3 - 1 AS BIGINT) mid, y, x_start, x_end FROM runs_v WHERE mask_id%3 > 0),
t AS (SELECT drawing_id, CAST(floor(mask_id/3)*2 + k AS BIGINT) mid, y, x_start, x_end FROM runs_v, range(2) r(k) WHERE mask_id%3 = 0),
pa AS (SELECT drawing_id, mid, sum(x_end-x_start) p FROM p GROUP BY drawing_id, mid),
ta AS (SELECT drawing_id, mid, sum(x_end-x_start) t FROM t GROUP BY drawing_id, mid),
i AS (SELECT p.drawing_id, p.mid, sum(greatest(0, least(p.x_end, t.x_end)-greatest(p.x_start, t.x_start))) i
  FROM p JOIN t ON p.drawing_id = t.drawing_id AND p.mid = t.mid AND p.y = t.y GROUP BY p.drawing_id, p.mid),
q AS (SELECT pa.drawing_id, floor(pa.mid/16) batch, coalesce(i, 0) i, p, t FROM pa
  JOIN ta ON pa.drawing_id = ta.drawing_id AND pa.mid = ta.mid
  LEFT JOIN i ON i.drawing_id = pa.drawing_id AND i.mid = pa.mid),
b AS (SELECT drawing_id, batch, avg(i/(p+t-i+1e-6)) iou, sum(1-(2*i+1)/(p+t+1)) dice, count(*) n FROM q GROUP BY drawing_id, batch)
SELECT drawing_id, round(avg(iou), 6) mean_iou, round(sum(dice)/sum(n), 6) mean_dice_loss FROM b GROUP BY drawing_id""")
def _(fx):
    # Of three copies of a mask the first is the truth, against which both others are held.
    runs = fx.runs.selectExpr("drawing_id", "mask_id % 3 kind", "CAST(floor(mask_id/3)*2 AS BIGINT) pair",
                              "y", "x_start", "x_end")
    both = F.explode(F.array(F.lit(0), F.lit(1)))
    shape = ["drawing_id", "mask_id", "y", "x_start", "x_end"]
    pred = runs.where("kind > 0").withColumn("mask_id", F.col("pair") + F.col("kind") - 1).select(*shape)
    truth = runs.where("kind = 0").withColumn("k", both).withColumn("mask_id", F.col("pair") + F.col("k")).select(*shape)
    batches = fx.symbols.select("drawing_id", (F.col("symbol_id") * 2).alias("pair"), both.alias("k")).selectExpr(
        "drawing_id", "pair + k mask_id", "floor((pair + k)/16) batch")
    scores = m.evaluate(pred, truth, batches)
    return scores.select("drawing_id", r6("mean_iou").alias("mean_iou"),
                         r6("mean_dice_loss").alias("mean_dice_loss"))


@query("agg_selection_stats", """
SELECT drawing_id, count(*) n, CAST(sum((x2-x1)*(y2-y1)) AS BIGINT) total_area, round(avg(score), 6) mean_score,
 string_agg("text", ' ' ORDER BY (text_id*37)%75) combined FROM texts_v WHERE text_id%6 = 0 GROUP BY drawing_id""")
def _(fx):
    selected = fx.texts.where("text_id % 6 = 0").withColumn("chosen_at", F.expr("(text_id*37)%75"))
    return ag.selection_stats(selected, "chosen_at").withColumn("mean_score", r6("mean_score"))


@query("agg_farthest_pair", """
WITH e AS (SELECT drawing_id, line_id%10 sel, line_id*2 idx, x1 px, y1 py FROM lines_v UNION ALL
  SELECT drawing_id, line_id%10, line_id*2+1, x2, y2 FROM lines_v),
p AS (SELECT a.drawing_id, a.sel, a.px x1, a.py y1, b.px x2, b.py y2, row_number() OVER
  (PARTITION BY a.drawing_id, a.sel ORDER BY (a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py) DESC, a.idx, b.idx) rn
  FROM e a JOIN e b ON a.drawing_id = b.drawing_id AND a.sel = b.sel AND a.idx < b.idx)
SELECT drawing_id, sel, x1, y1, x2, y2 FROM p WHERE rn = 1""")
def _(fx):
    ends = F.array(F.struct(F.expr("line_id*2 idx"), F.col("x1").alias("px"), F.col("y1").alias("py")),
                   F.struct(F.expr("line_id*2+1 idx"), F.col("x2").alias("px"), F.col("y2").alias("py")))
    points = fx.lines.select("drawing_id", F.expr("line_id%10 sel"), F.explode(ends).alias("e")).select(
        "drawing_id", "sel", "e.*")
    return ag.farthest_pair(points, ["drawing_id", "sel"])


@query("agg_combine_dir", """
WITH d AS (SELECT drawing_id, CAST(floor(line_id/3) AS BIGINT) sel, direction FROM lines_v)
SELECT drawing_id, sel, CASE count(DISTINCT direction) FILTER (WHERE direction <> 'none') WHEN 0 THEN 'none'
 WHEN 1 THEN max(direction) FILTER (WHERE direction <> 'none') ELSE 'bidirectional' END direction
FROM d GROUP BY drawing_id, sel""")
def _(fx):
    return fx.lines.groupBy("drawing_id", F.expr("CAST(floor(line_id/3) AS BIGINT)").alias("sel")).agg(
        ag.combined_direction(F.col("direction")).alias("direction"))


# --- order and limit ---------------------------------------------------------


@query("win_chain_order", "WITH " + BY_FIVE + """
SELECT drawing_id, chain_id, symbol_id,
 row_number() OVER (PARTITION BY drawing_id, chain_id ORDER BY pos, first_member, symbol_id) - 1 k FROM hits""")
def _(fx):
    hits = graph.chain_hits(chains_of_five(fx), fx.symbols, 50.0)
    placed = with_position(hits, ["drawing_id", "chain_id"], ["pos", "first_member", "symbol_id"], "k")
    return placed.select("drawing_id", "chain_id", "symbol_id", "k")


@query("win_consecutive", "WITH " + BY_FIVE + """,
o AS (SELECT *, lead(symbol_id) OVER (PARTITION BY drawing_id, chain_id ORDER BY pos, first_member, symbol_id) nxt FROM hits)
SELECT drawing_id, chain_id, symbol_id, nxt next_symbol_id FROM o WHERE nxt IS NOT NULL AND nxt <> symbol_id""")
def _(fx):
    links = graph.chain_links(chains_of_five(fx).withColumn("direction", F.lit("none")), fx.symbols, 50.0)
    return links.selectExpr("drawing_id", "chain_id", "source symbol_id", "target next_symbol_id")


@query("win_link_direction", LINKS + """
SELECT drawing_id, chain_id, k, source, target, "type", direction, round(len, 6) length FROM links""")
def _(fx):
    return _own_links(fx).select("drawing_id", "chain_id", "k", "source", "target", "type", "direction",
                                 r6("length").alias("length"))


@query("win_dedup_pairs", LINKS + """
SELECT drawing_id, link_id, source, target, "type", direction, x1, y1, x2, y2 FROM deduped""")
def _(fx):
    return graph.dedup_pairs(_own_links(fx)).select(
        "drawing_id", "link_id", "source", "target", "type", "direction", "x1", "y1", "x2", "y2")


@query("win_reading_order", """
SELECT drawing_id, text_id, row_number() OVER (PARTITION BY drawing_id ORDER BY y1, x1, text_id) - 1 position FROM texts_v""")
def _(fx):
    return with_position(fx.texts, ["drawing_id"], ["y1", "x1", "text_id"]).select(
        "drawing_id", "text_id", "position")


@query("win_cluster_order", NOISY + """,
s AS (SELECT cluster_id, count(*) n, min(vec_id) f FROM noisy GROUP BY cluster_id)
SELECT cluster_id, n, row_number() OVER (ORDER BY cluster_id = -1, n DESC, f) - 1 place,
 (SELECT max(cluster_id)+1 FROM s) next_id FROM s""")
def _(fx):
    return ag.cluster_order(noisy_clusters(fx), "vec_id")


@query("win_even_sample", """
WITH o AS (SELECT cluster_id, vec_id, row_number() OVER (PARTITION BY cluster_id ORDER BY vec_id) - 1 position,
  count(*) OVER (PARTITION BY cluster_id) n FROM clusters_v)
SELECT cluster_id, vec_id, position FROM o WHERE n <= 32
 OR position IN (SELECT CAST(floor(i*n/32.0) AS BIGINT) FROM range(0, 32) r(i))""")
def _(fx):
    return ag.even_sample(fx.clusters, "cluster_id", "vec_id").select("cluster_id", "vec_id", "position")


@query("win_score_rank", """
SELECT drawing_id, det_id, row_number() OVER (PARTITION BY drawing_id ORDER BY score DESC, det_id) - 1 position FROM dets_v""")
def _(fx):
    return with_position(fx.detections, ["drawing_id"], [F.desc("score"), "det_id"]).select(
        "drawing_id", "det_id", "position")


@query("win_seg_offset", CHAIN_AGG + """
SELECT drawing_id, chain_id, pos member_pos, round(coalesce(sum(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))) OVER
 (PARTITION BY drawing_id, chain_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) start FROM c""")
def _(fx):
    return chains_of_five(fx).select("drawing_id", "chain_id", "member_pos", r6("start").alias("start"))


@query("win_topk", "WITH " + ASSIGNED + """,
r AS (SELECT *, row_number() OVER (PARTITION BY drawing_id, symbol_id ORDER BY dist, text_id) r FROM assigned)
SELECT drawing_id, symbol_id, text_id, r AS "rank" FROM r WHERE r <= 2""")
def _(fx):
    assigned = graph.assign_texts(fx.texts, fx.symbols)
    top = ag.first_of_group(assigned, ["drawing_id", "symbol_id"], ["distance", "text_id"], 2)
    return top.select("drawing_id", "symbol_id", "text_id", F.col("rank").cast("bigint").alias("rank"))


# --- set operations ----------------------------------------------------------


@query("set_union_lines", """
SELECT drawing_id, row_number() OVER (PARTITION BY drawing_id ORDER BY line_type = 'dashed', line_id) - 1 new_id,
 line_id, line_type FROM lines_v""")
def _(fx):
    solid, dashed = fx.lines.where("line_type = 'solid'"), fx.lines.where("line_type = 'dashed'")
    pooled = solid.unionByName(dashed)
    return with_position(pooled, ["drawing_id"], [F.expr("line_type = 'dashed'"), "line_id"], "new_id").select(
        "drawing_id", "new_id", "line_id", "line_type")


@query("set_union_scales", """
WITH t AS (SELECT t.*, width, height, k FROM texts_v t JOIN drawings_v d ON t.drawing_id = d.drawing_id
  CROSS JOIN (SELECT 1.0 k UNION ALL SELECT 1.5 UNION ALL SELECT 2.0) q WHERE score >= 0.22),
p AS (SELECT drawing_id, text_id, k, greatest(0, least(width-1, CAST(round_even((x1+100)/k, 0) AS BIGINT))) x1,
  greatest(0, least(height-1, CAST(round_even((y1+50)/k, 0) AS BIGINT))) y1,
  greatest(0, least(width-1, CAST(round_even((x2+100)/k, 0) AS BIGINT))) x2,
  greatest(0, least(height-1, CAST(round_even((y2+50)/k, 0) AS BIGINT))) y2 FROM t)
SELECT drawing_id, text_id, CAST(k AS DOUBLE) scale, x1, y1, x2, y2 FROM p WHERE x2-x1 >= 3 AND y2-y1 >= 3""")
def _(fx):
    found = f.confident(fx.texts, 0.22).join(fx.drawings, "drawing_id")

    def at_scale(scale):
        moved = g.rescale_to_page(box(), F.lit(100), F.lit(50), F.lit(scale), F.col("width"), F.col("height"))
        return found.select("drawing_id", "text_id", F.lit(scale).alias("scale"),
                            *(c.alias(n) for c, n in zip(moved, ("x1", "y1", "x2", "y2"))))

    pooled = at_scale(1.0).unionByName(at_scale(1.5)).unionByName(at_scale(2.0))
    return pooled.where((g.width(box()) >= 3) & (g.height(box()) >= 3))


@query("set_distinct_lines", """
WITH c AS (SELECT drawing_id, line_id, line_type, CAST(floor(x1/300) AS BIGINT) x1, CAST(floor(y1/300) AS BIGINT) y1,
  CAST(floor(x2/300) AS BIGINT) x2, CAST(floor(y2/300) AS BIGINT) y2 FROM lines_v),
n AS (SELECT *, CASE WHEN x1 < x2 OR (x1 = x2 AND y1 <= y2) THEN (x1, y1, x2, y2) ELSE (x2, y2, x1, y1) END e FROM c),
r AS (SELECT *, row_number() OVER w rn, count(*) OVER (PARTITION BY drawing_id, line_type, e) copies FROM n
  WINDOW w AS (PARTITION BY drawing_id, line_type, e ORDER BY line_id))
SELECT drawing_id, line_id, line_type, x1, y1, x2, y2, copies FROM r WHERE rn = 1""")
def _(fx):
    coarse = fx.lines.selectExpr("drawing_id", "line_id", "line_type", *(
        f"CAST(floor({c}/300) AS BIGINT) {c}" for c in ("x1", "y1", "x2", "y2")))
    return ag.exact_duplicates(coarse)


@query("set_split_valid", PATTERNS + """,
s AS (SELECT *, category <> '' AND EXISTS (SELECT 1 FROM pat
 WHERE contains(trim(lower(category)), p) OR contains(p, trim(lower(category)))) d FROM lab)
SELECT drawing_id, symbol_id, CASE WHEN d THEN 'discarded_symbols' ELSE 'symbols' END part FROM s""")
def _(fx):
    split = f.discard_split(labelled(fx))
    valid = split.where("NOT discarded").withColumn("part", F.lit("symbols"))
    discarded = split.where("discarded").withColumn("part", F.lit("discarded_symbols"))
    return valid.unionByName(discarded).select("drawing_id", "symbol_id", "part")

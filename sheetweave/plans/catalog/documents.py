"""Sources, sinks, incremental work and the whole graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sheetweave.operators import filters as f
from sheetweave.operators import folds, graph, masks as m
from sheetweave.plans import digitize
from sheetweave.plans.catalog.filters import PATTERNS, labelled
from sheetweave.plans.catalog.joins import ASSIGNED, HITS, own_chains
from sheetweave.plans.catalog.iterative import CHAINS, TEXT_ITEM
from sheetweave.plans.catalog import sweepsql as sw
from sheetweave.plans.catalog.registry import SOURCE, query, r6
from sheetweave.scratch import Scratch
from sheetweave.sources import readers, sinks
from sheetweave.streaming import ingest


COUNTERS = ["total_symbols", "total_connections", "full_connections", "total_text_detections", "total_lines",
            "lines_with_direction", "skipped_no_partial_connection", "skipped_self_loops"]


def _headers(fx):
    return fx.drawings.select("drawing_id", F.expr("concat('images/', drawing_id, '.png')").alias("image_path"),
                              F.create_map(F.lit("detector"), F.lit("boxes")).alias("params"))


def _through_files(fx, docs):
    """Documents written as one file per drawing and read again."""
    path = f"{Scratch(fx.spark).base}/documents"
    if "part" not in docs.columns:
        docs = docs.withColumn("part", F.lit(0))
    sinks.write_documents(docs, path)
    return readers.documents(fx.spark, path).withColumn("drawing_id", F.col("drawing_id").cast("bigint"))


def _whole(table):
    return table.withColumns({c: F.col(c).cast("bigint") for c in ("x1", "y1", "x2", "y2")})


def _document(rows, order, entry, wrap="%s"):
    """One JSON list per drawing, as a table of documents."""
    ordered = F.sort_array(F.collect_list(F.struct(order, F.to_json(entry).alias("e"))))
    text = F.concat(F.lit("["), F.array_join(ordered["e"], ","), F.lit("]"))
    return rows.groupBy("drawing_id").agg(F.format_string(wrap, text).alias("value"))


@query("src_detections", """
SELECT drawing_id, det_id, score, x1, y1, x2, y2, (x2-x1)*(y2-y1) area, (det_id%3)*2 prompt_size FROM dets_v
WHERE det_id%10 <> 7""")
def _(fx):
    # Every tenth entry has an empty box; prompts are missing, points or boxes.
    rows = fx.detections.select(
        "drawing_id", F.struct(
            F.col("det_id").alias("id"), "score", F.expr("(x2-x1)*(y2-y1)").alias("area"),
            F.when(F.expr("det_id%10 = 7"), F.expr("CAST(array() AS ARRAY<BIGINT>)"))
            .otherwise(F.array("x1", "y1", "x2", "y2")).alias("bbox"),
            F.when(F.expr("det_id%3 = 1"), F.array("x1", "y1")).alias("prompt_point"),
            F.when(F.expr("det_id%3 = 2"), F.array("x1", "y1", "x2", "y2")).alias("prompt_box")).alias("e"))
    docs = _document(rows.withColumn("id", F.col("e.id")), F.col("id"), F.col("e"), '{"masks_info":%s}')
    found = _whole(readers.parse_detections(_through_files(fx, docs)))
    return found.select("drawing_id", "det_id", "score", "x1", "y1", "x2", "y2", "area",
                        F.greatest(F.coalesce(F.size("prompt"), F.lit(0)), F.lit(0)).cast("bigint").alias("prompt_size"))


@query("src_text", """
SELECT drawing_id, text_id, "text", score, x1, y1, x2, y2 FROM texts_v WHERE text_id%5 <> 0""")
def _(fx):
    # Even drawings hold a list, odd ones a list under "detections"; some texts are blank.
    rows = fx.texts.select("drawing_id", "text_id", F.struct(
        F.array("x1", "y1", "x2", "y2").alias("bbox"),
        F.when(F.expr("text_id%5 = 0"), "  ").otherwise(F.col("text")).alias("text"), "score").alias("e"))
    docs = _document(rows, F.col("text_id"), F.col("e")).withColumn("value", F.when(
        F.expr("drawing_id%2 = 0"), F.col("value")).otherwise(F.format_string('{"detections":%s}', "value")))
    found = _whole(readers.parse_texts(_through_files(fx, docs)))
    return found.select("drawing_id", "text_id", "text", "score", "x1", "y1", "x2", "y2")


def _line_documents(fx):
    """Lines in both entry forms: lists, and objects with a direction."""
    line = F.array("x1", "y1", "x2", "y2")
    rows = fx.lines.select("drawing_id", "line_id", "line_type", F.when(
        F.expr("line_id%2 = 0"), F.to_json(F.struct(line.alias("line"), "direction")))
        .otherwise(F.to_json(line)).alias("e"))

    def listed(kind):
        part = F.sort_array(F.collect_list(F.when(F.col("line_type") == kind, F.struct("line_id", "e"))))
        return F.array_join(part["e"], ",")

    header = '{"solid":[%s],"dashed":[%s],"image_path":"p.png","target_width":7168,"scale":5.12}'
    return rows.groupBy("drawing_id").agg(
        F.format_string(header, listed("solid"), listed("dashed")).alias("value"))


@query("src_lines", """
SELECT drawing_id, row_number() OVER (PARTITION BY drawing_id ORDER BY line_type = 'dashed', line_id) - 1 line_id,
 line_type, CASE WHEN line_id%2 = 0 THEN direction ELSE 'none' END direction, x1, y1, x2, y2, 5.12::DOUBLE scale FROM lines_v""")
def _(fx):
    docs = _through_files(fx, _line_documents(fx))
    head = readers.parse_line_header(docs).select("drawing_id", "scale")
    return _whole(readers.parse_lines(docs)).join(head, "drawing_id")


@query("src_symbols", PATTERNS + """,
k AS (SELECT l.*, category <> '' AND EXISTS (SELECT 1 FROM pat WHERE contains(trim(lower(category)), p)
  OR contains(p, trim(lower(category)))) d FROM lab l)
SELECT k.drawing_id, row_number() OVER (PARTITION BY k.drawing_id ORDER BY k.symbol_id) - 1 symbol_id,
 k.symbol_id mask_id, k.category, x1, y1, x2, y2, k.symbol_id%9-1 cluster_id
FROM k JOIN symbols_v s ON s.drawing_id = k.drawing_id AND s.symbol_id = k.symbol_id WHERE NOT d""")
def _(fx):
    docs = sinks.classification(_classified(fx), _headers(fx))
    found = _whole(readers.parse_symbols(_through_files(fx, docs)))
    return found.select("drawing_id", "symbol_id", "mask_id", "category", "x1", "y1", "x2", "y2", "cluster_id")


@query("src_ocr_arrays", """
SELECT drawing_id, row_number() OVER (PARTITION BY drawing_id ORDER BY text_id) - 1 idx, x1, y1, x2, y2, score, "text",
 4::BIGINT corners FROM texts_v""")
def _(fx):
    quad = F.expr("array(array(x1, y1), array(x2, y1), array(x2, y2), array(x1, y2))")
    ordered = F.sort_array(F.collect_list(F.struct(
        "text_id", F.array("x1", "y1", "x2", "y2").alias("b"), "score", "text", quad.alias("q"))))
    docs = fx.texts.groupBy("drawing_id").agg(F.to_json(F.struct(
        ordered["b"].alias("boxes"), ordered["score"].alias("scores"), ordered["text"].alias("texts"),
        ordered["q"].alias("quads"))).alias("value"))
    found = _whole(readers.parse_ocr(_through_files(fx, docs)))
    return found.select("drawing_id", "idx", "x1", "y1", "x2", "y2", "score", "text",
                        F.size("quad").cast("bigint").alias("corners"))


def _annotation_documents(fx):
    """Ragged rows: an id, often a box, a type, and for some a second box."""
    row = F.concat(
        F.format_string('["symbol_%d"', "symbol_id"),
        F.expr("IF(symbol_id%6 = 5, '', format_string(',[%d,%d,%d,%d]', x1, y1, x2, y2))"),
        F.format_string(',"%s"', "category"),
        F.expr("IF(symbol_id%4 = 1 AND symbol_id%6 <> 5, format_string(',[%d,%d,%d,%d]', x1+1, y1+1, x2+1, y2+1), '')"),
        F.lit("]"))
    ordered = F.sort_array(F.collect_list(F.struct("symbol_id", row.alias("e"))))
    return fx.symbols.groupBy("drawing_id").agg(
        F.concat(F.lit("["), F.array_join(ordered["e"], ","), F.lit("]")).alias("value"))


@query("src_annotations", """
SELECT drawing_id, symbol_id ann_id, x1+CASE WHEN symbol_id%4 = 1 THEN 1 ELSE 0 END x1, x1 first_x1, category symbol_type
FROM symbols_v WHERE symbol_id%6 <> 5""")
def _(fx):
    docs = _through_files(fx, _annotation_documents(fx))
    first = readers.parse_annotations(docs, first_box=True).select(
        "drawing_id", "ann_id", F.col("x1").cast("bigint").alias("first_x1"))
    last = readers.parse_annotations(docs).select(
        "drawing_id", "ann_id", F.col("x1").cast("bigint").alias("x1"), "symbol_type")
    return last.join(first, ["drawing_id", "ann_id"])


@query("src_masks", """
SELECT drawing_id, mask_id, y, x_start, x_end FROM runs_v WHERE drawing_id%2 = 0
UNION ALL SELECT drawing_id, mask_id, y, x1, x2 FROM (SELECT drawing_id, det_id mask_id, unnest(range(y1, y2)) y, x1, x2
 FROM dets_v WHERE drawing_id%2 <> 0) q""")
def _(fx):
    return m.stored_or_rectangles(fx.runs.where("drawing_id % 2 = 0"), fx.detections)


def _classified(fx):
    symbols = labelled(fx).withColumns({"mask_id": F.col("symbol_id"), "cluster_id": F.expr("symbol_id%9-1")})
    return f.discard_split(symbols)


@query("sink_classification", PATTERNS + """,
k AS (SELECT l.*, category <> '' AND EXISTS (SELECT 1 FROM pat WHERE contains(trim(lower(category)), p)
  OR contains(p, trim(lower(category)))) d FROM lab l)
SELECT drawing_id, 0::BIGINT part, count(*) detected, count(DISTINCT CASE WHEN symbol_id%9-1 >= 0 THEN symbol_id%9-1 END) clusters,
 count(*) FILTER (WHERE NOT d) valid, count(*) FILTER (WHERE d) discarded,
 count(*) FILTER (WHERE NOT d) listed, count(*) FILTER (WHERE category = 'unlabeled') unlabeled,
 count(*) FILTER (WHERE category = 'pump') pumps, count(*) FILTER (WHERE category = 'other') others FROM k GROUP BY drawing_id""")
def _(fx):
    docs = sinks.classification(_classified(fx), _headers(fx))
    d = F.from_json("value", """num_symbols_detected BIGINT, num_clusters BIGINT, num_symbols_valid BIGINT,
        num_symbols_discarded BIGINT, categories MAP<STRING, BIGINT>, discarded_categories MAP<STRING, BIGINT>,
        symbols ARRAY<STRUCT<id: BIGINT>>""")
    return docs.select(
        "drawing_id", "part", d["num_symbols_detected"].alias("detected"), d["num_clusters"].alias("clusters"),
        d["num_symbols_valid"].alias("valid"), d["num_symbols_discarded"].alias("discarded"),
        F.size(d["symbols"]).cast("bigint").alias("listed"), d["categories"]["unlabeled"].alias("unlabeled"),
        d["categories"]["pump"].alias("pumps"), d["discarded_categories"]["other"].alias("others"))


@query("sink_results_json", """
SELECT drawing_id, det_id, score, x1, y2, CASE WHEN det_id%2 = 0 THEN 'point' ELSE 'box' END prompt,
 (SELECT count(*) FROM dets_v q WHERE q.drawing_id = d.drawing_id) num_masks FROM dets_v d""")
def _(fx):
    rows = fx.detections.withColumns({
        "area": F.expr("(x2-x1)*(y2-y1)"),
        "prompt": F.when(F.expr("det_id%2 = 0"), F.array("x1", "y1")).otherwise(F.array("x1", "y1", "x2", "y2"))})
    docs = sinks.results(rows, _headers(fx))
    # Parsed below the explode: what stands beside a generator is evaluated for each row that it makes. The
    # outer one, as Spark puts a filter below the other that parses once more; every part has entries.
    d = F.from_json("value", readers.DETECTIONS)
    parsed = docs.select("drawing_id", d["num_masks"].alias("num_masks"), d["masks_info"].alias("entries"))
    flat = parsed.select("drawing_id", "num_masks", F.explode_outer("entries").alias("e")).where("e IS NOT NULL")
    return flat.select(
        "drawing_id", F.col("e.id").alias("det_id"), "e.score", F.get("e.bbox", 0).cast("bigint").alias("x1"),
        F.get("e.bbox", 3).cast("bigint").alias("y2"),
        F.when(F.col("e.prompt_point").isNotNull(), "point").when(F.col("e.prompt_box").isNotNull(), "box").alias("prompt"),
        "num_masks")


@query("sink_points_json", """
SELECT drawing_id, count(*) num_detections, round(sum((x1+x2)/2.0), 6) sum_x, round(sum((y1+y2)/2.0), 6) sum_y,
 count(*) labels, true named FROM symbols_v GROUP BY drawing_id""")
def _(fx):
    docs = sinks.prompt_points(fx.symbols.withColumnRenamed("symbol_id", "det_id"), _headers(fx))
    kind = "num_detections BIGINT, sam2_prompts STRUCT<points: ARRAY<ARRAY<DOUBLE>>, labels: ARRAY<BIGINT>>"
    single = docs.select("drawing_id", F.from_json("value", kind).alias("d"))
    total = (lambda i: F.aggregate("d.sam2_prompts.points", F.lit(0.0), lambda s, p: s + p[i]))
    names = (sinks.combined_points(docs).select(
        F.explode(F.map_keys(F.from_json("value", "MAP<STRING, STRING>"))).alias("drawing_id"),
        F.lit(True).alias("named")).withColumn("drawing_id", F.col("drawing_id").cast("bigint")))
    return single.select(
        "drawing_id", "d.num_detections", r6(total(0)).alias("sum_x"), r6(total(1)).alias("sum_y"),
        F.aggregate("d.sam2_prompts.labels", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("labels")).join(
        names, "drawing_id")


@query("sink_yolo_labels", r"""
SELECT s.drawing_id, CASE WHEN s.drawing_id%10 < 9 THEN 'train' ELSE 'val' END split, 0::BIGINT part,
 string_agg(printf('0 %.6f %.6f %.6f %.6f', greatest(0.0, least(1.0, ((x1+x2)/2.0)/width)),
 greatest(0.0, least(1.0, ((y1+y2)/2.0)/height)), greatest(0.0, least(1.0, (x2-x1)/width)),
 greatest(0.0, least(1.0, (y2-y1)/height))), chr(10) ORDER BY symbol_id) "value"
FROM symbols_v s JOIN drawings_v d ON s.drawing_id = d.drawing_id GROUP BY s.drawing_id""")
def _(fx):
    splits = fx.drawings.selectExpr("drawing_id", "IF(drawing_id%10 < 9, 'train', 'val') split")
    path = f"{Scratch(fx.spark).base}/labels"
    sinks.write_labels(sinks.label_files(fx.symbols.withColumnRenamed("symbol_id", "ann_id"), fx.drawings, splits), path)
    files = fx.spark.read.text(f"{path}/labels", wholetext=True)
    return files.selectExpr("CAST(drawing_id AS BIGINT) drawing_id", "split", "CAST(part AS BIGINT) part", "rtrim('\n', value) value")


@query("src_run_header", """
SELECT drawing_id, concat('images/', drawing_id, '.png') image_path, count(*) num_masks, 'boxes' detector
FROM dets_v GROUP BY drawing_id""")
def _(fx):
    rows = fx.detections.withColumn("area", F.expr("(x2-x1)*(y2-y1)"))
    runs = readers.parse_runs(_through_files(fx, sinks.results(rows, _headers(fx))))
    return runs.select("drawing_id", "image_path", F.col("num_masks").cast("bigint").alias("num_masks"),
                       F.expr("params['detector']").alias("detector"))


OWN_CHAINS = ("WITH " + HITS.format(chain="line_id", pos="0", reach=50) + """,
kept AS (SELECT h.*, line_type, direction, row_number() OVER (PARTITION BY h.drawing_id, chain_id
  ORDER BY pos, first_member, symbol_id) - 1 k FROM hits h JOIN members mm USING (drawing_id, chain_id)),
steps AS (SELECT *, lead(symbol_id) OVER (PARTITION BY drawing_id, chain_id ORDER BY k) nxt FROM kept),
links AS (SELECT drawing_id, chain_id, k, CASE WHEN direction = 'backward' THEN nxt ELSE symbol_id END source,
  CASE WHEN direction = 'backward' THEN symbol_id ELSE nxt END target, line_type kind, direction FROM steps WHERE nxt IS NOT NULL),
first AS (SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY drawing_id, least(source, target),
  greatest(source, target) ORDER BY chain_id, k) = 1)
""")


NODES = """SELECT s.drawing_id, s.symbol_id, s.category, coalesce(string_agg("text", ' | ' ORDER BY dist, text_id), '') captions
FROM symbols_v s LEFT JOIN assigned a ON a.drawing_id = s.drawing_id AND a.symbol_id = s.symbol_id
GROUP BY s.drawing_id, s.symbol_id, s.category"""
NUMBERED = "SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY chain_id, k) - 1 n FROM first"
COMPACT = OWN_CHAINS + "," + ASSIGNED + f"""
SELECT drawing_id, 'node' entry, symbol_id id, category || ': ' || captions shown FROM ({NODES})
UNION ALL SELECT drawing_id, 'link', n, concat_ws(' ', source, target, kind, CASE WHEN direction = 'bidirectional' THEN 'both' END)
 FROM ({NUMBERED})"""


def _graph_of_own_chains(fx):
    members = own_chains(fx)
    hits = graph.chain_hits(members, fx.symbols, 50.0)
    links = graph.dedup_pairs(graph.link_hits(hits, members, 50.0))
    nodes = graph.build_nodes(fx.symbols.drop("score"), graph.assign_texts(fx.texts, fx.symbols))
    return nodes, links, graph.metadata(nodes, links, fx.texts, fx.lines, hits, members, fx.drawings)


def _compact_entries(docs):
    kind = """nodes ARRAY<STRUCT<id: BIGINT, category: STRING, captions: ARRAY<STRING>>>,
        links ARRAY<STRUCT<`from`: BIGINT, `to`: BIGINT, type: STRING, bidirectional: BOOLEAN>>"""
    d = F.from_json("value", kind)
    nodes = docs.select("drawing_id", F.explode(d["nodes"]).alias("n")).select(
        "drawing_id", F.lit("node").alias("entry"), F.col("n.id").alias("id"),
        F.concat("n.category", F.lit(": "), F.array_join("n.captions", " | ")).alias("shown"))
    links = docs.select("drawing_id", F.posexplode(d["links"]).alias("n", "e")).select(
        "drawing_id", F.lit("link").alias("entry"), F.col("n").cast("bigint").alias("id"),
        F.concat_ws(" ", "e.from", "e.to", "e.type", F.when(F.col("e.bidirectional"), "both")).alias("shown"))
    return nodes.unionByName(links)


@query("sink_llm_json", COMPACT)
def _(fx):
    nodes, links, _ = _graph_of_own_chains(fx)
    return _compact_entries(sinks.compact_graph(nodes, links))


@query("sink_packed", COMPACT)
def _(fx):
    nodes, links, _ = _graph_of_own_chains(fx)
    path = f"{Scratch(fx.spark).base}/packed"
    sinks.write_packed(sinks.compact_graph(nodes, links), path, 8)
    return _compact_entries(sinks.read_packed(fx.spark, path, buckets=8))


@query("sink_full_json", OWN_CHAINS + "," + ASSIGNED + f"""
SELECT drawing_id, 'node' entry, symbol_id id, concat_ws('/', category, x1, y1, x2, y2, captions) shown FROM ({NODES}) JOIN (
 SELECT drawing_id, symbol_id, x1, y1, x2, y2 FROM symbols_v) q USING (drawing_id, symbol_id)
UNION ALL SELECT f.drawing_id, 'link', n, concat_ws('/', source, target, kind, CASE WHEN f.direction = 'backward' THEN 'forward'
 ELSE f.direction END, f.direction, l.x1, l.y1, l.x2, l.y2)
 FROM ({NUMBERED}) f JOIN lines_v l ON l.drawing_id = f.drawing_id AND l.line_id = f.chain_id
UNION ALL SELECT drawing_id, 'texts', 0, count(*)::VARCHAR FROM texts_v GROUP BY drawing_id""")
def _(fx):
    kind = """nodes ARRAY<STRUCT<id: BIGINT, category: STRING, bbox: ARRAY<BIGINT>, captions: ARRAY<STRING>>>,
        links ARRAY<STRUCT<id: BIGINT, source: BIGINT, target: BIGINT, type: STRING, direction: STRING, line: ARRAY<BIGINT>,
        connection_quality: STRUCT<direction_used: STRING>>>, metadata STRUCT<total_text_detections: BIGINT>"""
    docs = sinks.full_graph(*_graph_of_own_chains(fx)).select("drawing_id", F.from_json("value", kind).alias("d"))
    joined = (lambda c: F.concat_ws("/", F.col(c).cast("array<string>")))
    nodes = docs.select("drawing_id", F.explode("d.nodes").alias("e")).select(
        "drawing_id", F.lit("node").alias("entry"), "e.id",
        F.concat_ws("/", "e.category", joined("e.bbox"), F.array_join("e.captions", " | ")).alias("shown"))
    links = docs.select("drawing_id", F.explode("d.links").alias("e")).select(
        "drawing_id", F.lit("link").alias("entry"), "e.id", F.concat_ws(
            "/", "e.source", "e.target", "e.type", "e.direction", "e.connection_quality.direction_used", joined("e.line")).alias("shown"))
    texts = docs.where("d.metadata.total_text_detections > 0").selectExpr(
        "drawing_id", "'texts' entry", "0L id", "CAST(d.metadata.total_text_detections AS STRING) shown")
    return nodes.unionByName(links).unionByName(texts)


@query("src_skip_done", """
SELECT drawing_id, CASE WHEN drawing_id%2 = 0 THEN 'first' ELSE 'second' END run, count(*) n FROM symbols_v
GROUP BY drawing_id""")
def _(fx):
    # A first run that got through half of the drawings, and a second one over all.
    path = f"{Scratch(fx.spark).base}/skip_done"

    def stage(rows):
        return rows.groupBy("drawing_id").agg(F.count("*").alias("n"))

    ingest.run_missing(fx.symbols.where("drawing_id % 2 = 0"), stage, path, "first")
    ingest.run_missing(fx.symbols, stage, path, "second")
    # A third run that dies after its results and before its manifest: nobody sees them.
    stage(fx.symbols).write.parquet(f"{path}/run=died")
    return ingest.results(fx.spark, path).select("drawing_id", "run", "n")


@query("src_skip_done_stream", """
SELECT drawing_id, line_type, count(*) n FROM lines_v GROUP BY drawing_id, line_type""")
def _(fx):
    base = Scratch(fx.spark).base
    sinks.write_documents(_line_documents(fx).withColumn("part", F.lit(0)), f"{base}/incoming")

    def stage(docs):
        return readers.parse_lines(docs).groupBy("drawing_id", "line_type").agg(F.count("*").alias("n"))

    stream = ingest.stream_documents(fx.spark, f"{base}/incoming")
    ingest.follow(stream, stage, f"{base}/lines", f"{base}/progress").awaitTermination()
    return ingest.results(fx.spark, f"{base}/lines").select("drawing_id", "line_type", "n")


def _walked(reach):
    """The SQL of the whole graph: chains walked in SQL, then hits, steps and pairs."""
    members = """
cm AS (SELECT drawing_id, chain_id, line_id, row_number() OVER (PARTITION BY drawing_id, chain_id ORDER BY o) - 1 member_pos
  FROM members),"""
    hits = HITS.format(chain="c.chain_id", pos="c.member_pos", reach=reach)
    hits = hits.replace("members AS (", "mem AS (").replace("FROM members", "FROM mem").replace(
        "FROM lines_v)", "FROM lines_v l JOIN cm c USING (drawing_id, line_id))").replace(
        "c.chain_id chain_id, c.member_pos member_pos, ", "")
    hits = hits.replace("SELECT *, sqrt", "SELECT drawing_id, line_id, line_type, direction, x1, y1, x2, y2, "
                        "c.chain_id, c.member_pos, sqrt", 1)
    return CHAINS + "," + members + hits + """,
dirs AS (SELECT drawing_id, chain_id, arg_min(line_type, member_pos) kind,
  coalesce(arg_min(direction, member_pos) FILTER (WHERE direction <> 'none'), 'none') direction FROM mem GROUP BY drawing_id, chain_id),
kept AS (SELECT h.*, kind, direction, row_number() OVER (PARTITION BY h.drawing_id, h.chain_id
  ORDER BY pos, first_member, symbol_id) - 1 k FROM hits h JOIN dirs USING (drawing_id, chain_id)),
steps AS (SELECT *, lead(symbol_id) OVER (PARTITION BY drawing_id, chain_id ORDER BY k) nxt FROM kept),
links AS (SELECT drawing_id, chain_id, k, CASE WHEN direction = 'backward' THEN nxt ELSE symbol_id END source,
  CASE WHEN direction = 'backward' THEN symbol_id ELSE nxt END target, kind,
  CASE WHEN direction = 'backward' THEN 'forward' ELSE direction END direction FROM steps WHERE nxt IS NOT NULL),
ranked AS (SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY drawing_id, least(source, target),
  greatest(source, target) ORDER BY chain_id, k) = 1)
"""


LINKS = """SELECT drawing_id, row_number() OVER (PARTITION BY drawing_id ORDER BY chain_id, k) - 1 link_id, source, target,
 kind "type", direction FROM ranked"""


@query("it_assemble_graph", _walked(50) + LINKS)
def _(fx):
    header = fx.drawings.selectExpr("drawing_id", "5.12D scale", "CAST(NULL AS BIGINT) resized_width")
    whole = digitize.assemble(fx.symbols, fx.texts, fx.lines, header)
    return whole.links.select("drawing_id", "link_id", "source", "target", "type", "direction")


def scoped(sql: str, **tables: str) -> str:
    """A statement whose fixture views are the given tables instead."""
    body = sql.strip().removeprefix("WITH RECURSIVE ").removeprefix("WITH ")
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS (SELECT * FROM {table})" for name, table in tables.items()) + (
        ",\n" if body != sql.strip() else "\n") + body


def _item(raw: str, width: str, pages: str) -> str:
    """A table of texts as the walks want it."""
    return (f"SELECT t.drawing_id, text_id, x1, y1, x2, y2, {raw} t, \"text\" raw, score, {width} w FROM {{}} t"
            f" JOIN {pages} d ON t.drawing_id = d.drawing_id")


NORMAL = "regexp_replace(trim(\"text\"), '\\s+', ' ', 'g')"


def cleaned_texts(source: str, pages: str, last: str) -> str:
    """CTEs from pooled texts to the table ``last``: suppression, validity, rows and blocks."""
    kept = scoped(SOURCE["it_nms_text"], dets_v="(SELECT *, text_id det_id FROM confident)")
    item = _item(NORMAL, "width", pages)
    rows = sw.walk("rowed", "start", "drawing_id", sw.TEXT_FIELDS, "y1, x1, text_id", sw.rows_join, sw.rows_union, resort=sw.READING)
    blocks = sw.walk("blocked", "rowed", "drawing_id", "'id': o.id, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2, 't': o.t, 's': o.s",
                     "o.y1, o.x1, o.id", sw.blocks_join, sw.blocks_union, resort=sw.READING)
    close = sw.walk("closed", "start", "drawing_id", sw.TEXT_FIELDS.replace("'t': t", "'t': raw"), "y1, x1, text_id",
                    sw.close_join, sw.close_union, passes=False)
    return f"""
confident AS (SELECT * FROM {source} WHERE score >= 0.22),
kept_texts AS ({kept}),
valid_texts AS ({scoped(SOURCE["flt_text_valid"], texts_v="confident")}),
valid AS (SELECT c.* FROM confident c JOIN valid_texts USING (drawing_id, text_id)
  JOIN kept_texts k ON k.drawing_id = c.drawing_id AND k.det_id = c.text_id),
near_texts AS (WITH RECURSIVE start AS ({item.format("valid")}), {close} SELECT {TEXT_ITEM} FROM closed),
plausible AS (SELECT t.* FROM near_texts t JOIN {pages} d ON t.drawing_id = d.drawing_id
  WHERE NOT ((x2-x1 < 28 AND y2-y1 < 14) OR (x2-x1)/greatest(1, y2-y1) > 20 OR (y2-y1)/greatest(1, x2-x1) > 20
  OR (x2-x1)*(y2-y1) > 0.02*width*height OR score < 0.25)),
{last} AS (SELECT * FROM (WITH RECURSIVE start AS ({item.format("plausible")}), {rows}, {blocks} SELECT {TEXT_ITEM} FROM blocked) q
  WHERE NOT (trim("text") = '' OR (length(trim("text")) = 1 AND NOT regexp_matches(trim("text"), '[A-Za-z0-9]'))
  OR ((x2-x1)*(y2-y1) < 120 AND score < 0.5)))"""


@query("it_clean_texts", "WITH RECURSIVE " + cleaned_texts("texts_v", "drawings_v", "clean").strip() + """
SELECT drawing_id, text_id, x1, y1, x2, y2, "text", score FROM clean""")
def _(fx):
    return digitize.clean_texts(fx.texts, fx.drawings).select(
        "drawing_id", "text_id", "x1", "y1", "x2", "y2", "text", "score")


SOLID = "solid AS (" + SOURCE["flt_solid"] + """),
solid_lines AS (SELECT l.* FROM lines_v l JOIN solid USING (drawing_id, line_id))"""


@query("it_clean_lines", "WITH RECURSIVE " + SOLID + "," + "merged_lines AS (" + scoped(
    SOURCE["it_merge_segments"], lines_v="solid_lines") + """)
SELECT * FROM merged_lines""")
def _(fx):
    return digitize.clean_lines(fx.lines, fx.ink, fx.drawings)


# The fixtures as an image of half the size of the page: texts found at two scales of it, on tiles.
FOUND = """SELECT drawing_id, text_id*2+k text_id, CASE k WHEN 0 THEN 0.5D0 ELSE 0.75D0 END scale, 100 x0, 50 y0,
  CAST(floor(x1*(1+k*0.5D0)) AS BIGINT)-100 x1, CAST(floor(y1*(1+k*0.5D0)) AS BIGINT)-50 y1,
  CAST(floor(x2*(1+k*0.5D0)) AS BIGINT)-100 x2, CAST(floor(y2*(1+k*0.5D0)) AS BIGINT)-50 y2, "text", score
FROM {texts}"""
CLOSER = """SELECT drawing_id, text_id, CAST(floor(x1/8) AS BIGINT)*6 x1, CAST(floor(y1/24) AS BIGINT)*14 y1,
  CAST(floor(x1/8) AS BIGINT)*6+x2-x1 x2, CAST(floor(y1/24) AS BIGINT)*14+y2-y1 y2, "text", score FROM {texts}"""
TWICE = "x1*2 x1, y1*2 y1, x2*2 x2, y2*2 y2"
SEARCHED = """
found AS (""" + FOUND.replace("D0", "").format(texts="(SELECT *, unnest([0::BIGINT, 1]) k FROM (" + CLOSER.format(
    texts="texts_v") + "))") + f"""),
pages AS (SELECT drawing_id, width*2 width, height*2 height FROM drawings_v),
placed AS (SELECT f.drawing_id, text_id, "text", score, {", ".join(
    f"greatest(0, least({s}-1, CAST(round_even(({c}+{o})/scale, 0) AS BIGINT))) {c}"
    for c, s, o in (("x1", "width", "x0"), ("y1", "height", "y0"), ("x2", "width", "x0"), ("y2", "height", "y0")))}
  FROM found f JOIN pages p ON p.drawing_id = f.drawing_id WHERE score >= 0.22),
pooled AS (SELECT * FROM placed WHERE x2-x1 >= 3 AND y2-y1 >= 3),"""
AREAS = f"""
erased_texts AS (SELECT t.drawing_id, {", ".join(
    f"greatest(0, least(CAST(round_even(({c}{o}2)*0.5, 0) AS BIGINT), {s}-1)) {c}"
    for c, s, o in (("x1", "width", "-"), ("y1", "height", "-"), ("x2", "width", "+"), ("y2", "height", "+")))}
  FROM clean t JOIN drawings_v d ON d.drawing_id = t.drawing_id),
symbol_areas AS (SELECT drawing_id, x1-4 x1, y1-4 y1, x2+5 x2, y2+5 y2 FROM symbols_v WHERE symbol_id%5 = 0 AND (x2-x1)*(y2-y1) >= 600
  AND greatest(x2-x1, y2-y1) <= 260 AND greatest(x2-x1, y2-y1)/(least(x2-x1, y2-y1)+1e-6) <= 2.8),
shades AS (SELECT * FROM erased_texts UNION ALL SELECT * FROM symbol_areas),
left_ink AS (SELECT drawing_id, x_start px, y py, 1 hit FROM ({SOURCE["flt_notes_frame"]}) i WHERE NOT EXISTS
  (SELECT 1 FROM shades s WHERE s.drawing_id = i.drawing_id AND x_start BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2)),
solid AS ({scoped(SOURCE["flt_solid"], samples_v="left_ink")}),
page_lines AS (SELECT l.drawing_id, line_id, {TWICE} FROM lines_v l JOIN solid USING (drawing_id, line_id)),
merged_lines AS ({scoped(SOURCE["it_merge_segments"], lines_v="page_lines")}),
graph_lines AS (SELECT *, 'solid' line_type, CASE line_id%4 WHEN 1 THEN 'forward' WHEN 2 THEN 'backward' ELSE 'none' END direction
  FROM merged_lines),
graph_symbols AS (SELECT drawing_id, symbol_id, category, {TWICE} FROM symbols_v),
graph AS ({scoped(_walked(50), lines_v="graph_lines", symbols_v="graph_symbols")}
 SELECT drawing_id, 'link' what, *, '' k FROM ({LINKS.replace("SELECT drawing_id, row", "SELECT drawing_id d_, row")}) q JOIN
   (SELECT DISTINCT drawing_id FROM mem) m ON m.drawing_id = q.d_),
captions AS ({scoped("WITH " + ASSIGNED, texts_v="clean", symbols_v="graph_symbols")}
 SELECT drawing_id, symbol_id, string_agg("text", ' | ' ORDER BY dist, text_id) captions FROM assigned GROUP BY drawing_id, symbol_id),
alone AS ({scoped(_walked(50), lines_v="graph_lines", symbols_v="graph_symbols")}
 SELECT drawing_id, count(*) n FROM (SELECT m.drawing_id, m.chain_id FROM (SELECT DISTINCT drawing_id, chain_id FROM mem) m
   LEFT JOIN hits h ON h.drawing_id = m.drawing_id AND h.chain_id = m.chain_id GROUP BY m.drawing_id, m.chain_id
   HAVING count(symbol_id) < 2) GROUP BY drawing_id),
counters AS (SELECT drawing_id, (SELECT count(*) FROM graph_symbols s WHERE s.drawing_id = d.drawing_id) symbols,
  (SELECT count(*) FROM graph s WHERE s.drawing_id = d.drawing_id) links, (SELECT count(*) FROM clean s WHERE s.drawing_id = d.drawing_id) texts,
  (SELECT count(*) FROM graph_lines s WHERE s.drawing_id = d.drawing_id) lines,
  (SELECT count(*) FROM graph_lines s WHERE s.drawing_id = d.drawing_id AND direction <> 'none') directed,
  coalesce((SELECT n FROM alone s WHERE s.drawing_id = d.drawing_id), 0) alone FROM drawings_v d)"""


@query("it_digitize", "WITH RECURSIVE " + SEARCHED.strip() + cleaned_texts("pooled", "pages", "clean") + "," + AREAS + """
SELECT drawing_id, 'full node' entry, symbol_id id, concat_ws('/', category, x1, y1, x2, y2, coalesce(captions, '')) shown
 FROM graph_symbols LEFT JOIN captions USING (drawing_id, symbol_id)
UNION ALL SELECT drawing_id, 'compact node', symbol_id, concat_ws('/', category, coalesce(captions, ''))
 FROM graph_symbols LEFT JOIN captions USING (drawing_id, symbol_id)
UNION ALL SELECT drawing_id, 'full link', link_id, concat_ws('/', source, target, "type", direction) FROM graph
UNION ALL SELECT drawing_id, 'compact link', link_id, concat_ws('/', source, target, "type") FROM graph
UNION ALL SELECT drawing_id, 'counters', 0, concat_ws('/', symbols, links, links, texts, lines, directed, alone, 0) FROM counters""")
def _(fx):
    closer = fx.spark.sql(CLOSER.replace('"text"', "text").format(texts="{t}"), t=fx.texts)
    twice = closer.withColumn("k", F.explode(F.expr("array(0L, 1L)")))
    found = fx.spark.sql(FOUND.replace('"text"', "text").replace("D0", "D").format(texts="{t}"), t=twice)
    pages = fx.drawings.selectExpr("drawing_id", "width*2 width", "height*2 height")
    caps = fx.drawings.selectExpr("drawing_id", "0.5D cap_scale", "1.0D scale")
    symbols = fx.symbols.selectExpr("drawing_id", "symbol_id", "category", *TWICE.split(", "))
    frames = fx.symbols.selectExpr("drawing_id", "symbol_id contour_id", "x1 x", "y1 y", "(x2-x1)*12 w", "(y2-y1)*10 h", "4+symbol_id%9 vertices")
    components = fx.symbols.where("symbol_id % 5 = 0").selectExpr("drawing_id", "x1 x", "y1 y", "x2-x1 w", "y2-y1 h")
    header = fx.drawings.selectExpr("drawing_id", "CAST(NULL AS DOUBLE) scale", "CAST(NULL AS BIGINT) resized_width")
    directions = fx.lines.where("line_id % 4 IN (1, 2)").selectExpr(
        "drawing_id", "line_id", "0 seq", "IF(line_id % 4 = 1, 'forward', 'backward') value")
    whole = digitize.digitize(found, fx.lines, fx.ink, symbols, header, pages, fx.drawings, caps, frames, components, directions)
    scratch = Scratch(fx.spark)
    full, compact = map(scratch.save, digitize.documents(whole))  # each is read for several kinds of entries
    kind = """nodes ARRAY<STRUCT<id: BIGINT, category: STRING, bbox: ARRAY<BIGINT>, captions: ARRAY<STRING>>>,
        links ARRAY<STRUCT<id: BIGINT, source: BIGINT, target: BIGINT, type: STRING, direction: STRING, `from`: BIGINT, `to`: BIGINT>>,
        metadata STRUCT<total_symbols: BIGINT, total_connections: BIGINT, full_connections: BIGINT, total_text_detections: BIGINT,
        total_lines: BIGINT, lines_with_direction: BIGINT, skipped_no_partial_connection: BIGINT, skipped_self_loops: BIGINT>"""

    def entries(docs, name, of, id_, *shown):
        rows = docs.select("drawing_id", F.posexplode(F.from_json("value", kind)[of]).alias("n", "e"))
        return rows.select("drawing_id", F.lit(name).alias("entry"), id_.cast("bigint").alias("id"), F.concat_ws("/", *shown).alias("shown"))

    e, captions = F.col("e"), F.array_join("e.captions", " | ")
    counters = F.from_json("value", kind)["metadata"]
    parts = [entries(full, "full node", "nodes", e["id"], "e.category", F.concat_ws("/", F.col("e.bbox").cast("array<string>")), captions),
             entries(compact, "compact node", "nodes", e["id"], "e.category", captions),
             entries(full, "full link", "links", e["id"], "e.source", "e.target", "e.type", "e.direction"),
             entries(compact, "compact link", "links", F.col("n"), "e.from", "e.to", "e.type"),
             full.where("part = 0").select("drawing_id", F.lit("counters").alias("entry"), F.lit(0).cast("bigint").alias("id"),
                                           F.concat_ws("/", F.array(*(
                                               counters[c].cast("string") for c in COUNTERS))).alias("shown"))]
    return reduce(lambda a, b: a.unionByName(b), parts)

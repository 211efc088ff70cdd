"""From symbols, texts and lines to nodes and links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetweave.functions import geometry as g
from sheetweave.functions import textrules
from sheetweave.functions.geometry import box
from sheetweave.operators.joining import large
from sheetweave.operators.ordering import with_position, with_successor, with_sum_before
from sheetweave.operators.spatial import pair_join, point_cells, segment_cells, with_cells
from sheetweave.scratch import Scratch

CELL = ["drawing_id", "cell_x", "cell_y"]
PLACE = ["x1", "y1", "x2", "y2"]
CAPTION_PAGE = 4096


# --- preparation -------------------------------------------------------------


def override_boxes(symbols: DataFrame, detections: DataFrame) -> DataFrame:
    """Symbol boxes replaced by those of the detection with the same mask id."""
    known = detections.select("drawing_id", F.col("det_id").alias("mask_id"),
                              *(F.col(c).alias(f"d_{c}") for c in PLACE))
    joined = symbols.join(large(known), ["drawing_id", "mask_id"], "left")
    return (joined.withColumns({c: F.coalesce(f"d_{c}", c) for c in PLACE})
            .drop(*(f"d_{c}" for c in PLACE)))


def first_lines(lines: DataFrame, count: int = 10) -> DataFrame:
    """The first lines of each drawing in order of their ids; each task passes on no more than these."""
    by_id = Window.partitionBy("drawing_id").orderBy("line_id")
    return lines.withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= count).drop("_n")


def scale_symbols(symbols: DataFrame, lines: DataFrame, header: DataFrame) -> DataFrame:
    """Brings symbols to the space of lines where that is more than twice as large.

    The header holds (drawing_id, scale, resized_width); without either of the
    two nothing is scaled, without a scale the ratio of the means is used.
    """
    mean = F.expr("(x1 + y1 + x2 + y2) / 4")
    line_mean = (first_lines(lines).groupBy("drawing_id")
                 .agg(F.avg(mean).alias("line_mean")))
    symbol_mean = symbols.groupBy("drawing_id").agg(F.avg(mean).alias("symbol_mean"))
    factor = (symbol_mean.join(header, "drawing_id", "left")
              .join(line_mean, "drawing_id", "left")
              .withColumn("line_mean", F.coalesce(
                  "line_mean", F.col("resized_width") / 2, F.lit(3500.0)))
              .withColumn("bbox_scaled", F.coalesce(
                  (F.col("scale").isNotNull() | F.col("resized_width").isNotNull())
                  & (F.col("line_mean") > F.col("symbol_mean") * 2), F.lit(False)))
              .withColumn("factor", F.coalesce("scale", F.expr("line_mean / symbol_mean")))
              .select("drawing_id", "bbox_scaled", "factor"))
    joined = symbols.join(large(factor), "drawing_id")
    return joined.withColumns({
        c: F.when(F.col("bbox_scaled"), (F.col(c) * F.col("factor")).cast("bigint")).otherwise(F.col(c))
        for c in PLACE}).drop("factor")


# --- texts and symbols -------------------------------------------------------


def _spoken(texts: DataFrame) -> DataFrame:
    return texts.withColumn("text", textrules.strip(F.col("text"))).where("text <> ''")


def _near_centers(centers: DataFrame, texts: DataFrame, reach: float) -> DataFrame:
    """Centres (drawing_id, cx, cy, ...) within the reach of a text box, copies of boxes folded.

    (drawing_id, t_x1 .. t_y2, distance, all columns of the centres)
    """
    boxes = texts.select("drawing_id", *(F.col(c).alias(f"t_{c}") for c in PLACE)).distinct()
    placed = point_cells(centers, F.col("cx"), F.col("cy"), reach)
    spread = with_cells(boxes, box("t_"), reach, reach).drop("low_x", "low_y")
    return (spread.join(large(placed), CELL).drop("cell_x", "cell_y")
            .withColumn("distance", g.point_box_distance(F.col("cx"), F.col("cy"), box("t_")))
            .where(F.col("distance") <= reach))


def assign_texts(texts: DataFrame, symbols: DataFrame, max_distance: float = 100.0) -> DataFrame:
    """Each text with the symbol whose centre is nearest to the text box.

    Equal distances go to the lowest symbol id. Adds symbol_id and distance.
    """
    texts = _spoken(texts)
    cx, cy = g.center(box())
    owner = (symbols.groupBy("drawing_id", cx.alias("cx"), cy.alias("cy"))
             .agg(F.min("symbol_id").alias("symbol_id")))
    named = [F.col(f"t_{c}").alias(c) for c in PLACE]
    near = (_near_centers(owner, texts, max_distance)
            .groupBy("drawing_id", *named)
            .agg(F.min(F.struct("distance", "symbol_id")).alias("best")))
    return (texts.join(large(near), ["drawing_id", *PLACE])
            .select(*texts.columns, "best.symbol_id", "best.distance"))


def nearest_texts(texts: DataFrame, symbols: DataFrame, max_distance: float = 100.0,
                  top: int = 3) -> DataFrame:
    """Per symbol the nearest texts within the distance; a text may serve many symbols."""
    texts = _spoken(texts)
    cx, cy = g.center(box())
    # Of copies of one text box no more than the first `top` can matter.
    first = Window.partitionBy("drawing_id", *PLACE).orderBy("text_id")
    few = texts.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= top).drop("_n")
    centers = symbols.select("drawing_id", cx.alias("cx"), cy.alias("cy")).distinct()
    near = _near_centers(centers, few, max_distance).select(
        "drawing_id", "cx", "cy", "distance", *(F.col(f"t_{c}").alias(c) for c in PLACE))
    by_distance = Window.partitionBy("drawing_id", "cx", "cy").orderBy("distance", "text_id")
    ranked = (near.join(large(few.select("drawing_id", *PLACE, "text_id", "text")), ["drawing_id", *PLACE])
              .withColumn("rank", F.row_number().over(by_distance)).where(F.col("rank") <= top)
              .select("drawing_id", "cx", "cy", "text_id", "text", "distance", "rank"))
    centered = symbols.select("drawing_id", "symbol_id", cx.alias("cx"), cy.alias("cy"))
    return centered.join(large(ranked), ["drawing_id", "cx", "cy"]).drop("cx", "cy")


def caption_pages(assigned: DataFrame, page_size: int = CAPTION_PAGE) -> DataFrame:
    """Captions of a symbol by distance, as arrays of at most ``page_size`` texts.

    A symbol with more texts has further pages, so no array grows without bound. Places are
    worked out for the texts of such symbols alone; the others need no sort but that of their array.
    """
    scratch = Scratch(assigned.sparkSession)
    key = ["drawing_id", "symbol_id"]
    assigned = scratch.save(assigned)
    large = scratch.save(assigned.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > page_size).select(*key))
    if large.isEmpty():
        paged = assigned.withColumn("page", F.lit(0).cast("bigint"))
    else:
        ranked = with_position(assigned.join(large, key, "left_semi"), key, ["distance", "text_id"], "_rank")
        paged = assigned.join(large, key, "left_anti").withColumn("page", F.lit(0).cast("bigint")).unionByName(
            ranked.withColumn("page", F.floor(F.col("_rank") / page_size)).drop("_rank"))
    detail = F.struct("distance", "text_id", "text", F.struct(*PLACE).alias("bbox"), F.col("score").alias("confidence"))
    rows = paged.groupBy(*key, "page").agg(F.sort_array(F.collect_list(detail)).alias("nearby"))
    return rows.select(*key, "page", F.col("nearby.text").alias("captions"),
                       F.transform("nearby", lambda d: F.struct(
                           d["text"].alias("text"), d["distance"].alias("distance"), d["bbox"].alias("bbox"),
                           d["confidence"].alias("confidence"))).alias("nearby"))


def build_nodes(symbols: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row per symbol (and per further caption page): the nodes of the graph."""
    joined = symbols.join(large(caption_pages(assigned)), ["drawing_id", "symbol_id"], "left")
    optional = {name: F.lit(None).cast(kind) for name, kind in (
        ("area", "bigint"), ("confidence", "double"), ("cluster_id", "bigint"), ("mask_id", "bigint"))
        if name not in symbols.columns}
    nearby = ("array<struct<text:string,distance:double,bbox:struct<x1:bigint,y1:bigint,"
              "x2:bigint,y2:bigint>,confidence:double>>")
    return (joined.withColumns(optional)
            .withColumns({
                "category": F.coalesce("category", F.lit("unknown")),
                "page": F.coalesce("page", F.lit(0)),
                "captions": F.coalesce("captions", F.array().cast("array<string>")),
                "nearby": F.coalesce(F.col("nearby").cast(nearby), F.array().cast(nearby))})
            .select("drawing_id", "symbol_id", "page", "category", *PLACE, "area", "captions",
                    "nearby", "confidence", "cluster_id", "mask_id"))


# --- lines and symbols -------------------------------------------------------


def line_endpoints(lines: DataFrame) -> DataFrame:
    """Two rows per line: (drawing_id, line_id, line_type, endpoint, px, py)."""
    ends = F.array(F.struct(F.lit("start").alias("endpoint"), F.col("x1").alias("px"), F.col("y1").alias("py")),
                   F.struct(F.lit("end").alias("endpoint"), F.col("x2").alias("px"), F.col("y2").alias("py")))
    return (lines.withColumn("_end", F.explode(ends))
            .select("drawing_id", "line_id", "line_type", "_end.*"))


def endpoint_symbols(lines: DataFrame, symbols: DataFrame, max_distance: float) -> DataFrame:
    """(drawing_id, px, py, symbol_id, distance): symbols near a distinct endpoint."""
    points = line_endpoints(lines).select("drawing_id", "px", "py").distinct()
    placed = point_cells(points, F.col("px"), F.col("py"), max_distance)
    spread = with_cells(symbols.select("drawing_id", "symbol_id", *PLACE), box(),
                        max_distance, max_distance).drop("low_x", "low_y")
    return (placed.join(large(spread), CELL)
            .withColumn("distance", g.point_box_distance(F.col("px"), F.col("py"), box()))
            .where(F.col("distance") <= max_distance)
            .select("drawing_id", "px", "py", "symbol_id", "distance"))


def connect_ends(lines: DataFrame, symbols: DataFrame, max_distance: float = 50.0) -> DataFrame:
    """Nearest symbol at each end; which ends must be met depends on the direction."""
    best = (endpoint_symbols(lines, symbols, max_distance).groupBy("drawing_id", "px", "py")
            .agg(F.min(F.struct("distance", "symbol_id")).alias("best")))

    def at(end: str, x: str, y: str) -> DataFrame:
        return best.select("drawing_id", F.col("px").alias(x), F.col("py").alias(y),
                           F.col("best.symbol_id").alias(end),
                           F.col("best.distance").alias(f"{end}_distance"))

    joined = (lines.join(large(at("source", "x1", "y1")), ["drawing_id", "x1", "y1"], "left")
              .join(large(at("target", "x2", "y2")), ["drawing_id", "x2", "y2"], "left"))
    has_source, has_target = F.col("source").isNotNull(), F.col("target").isNotNull()
    valid = (F.when(F.col("direction") == "none", has_source & has_target)
             .when(F.col("direction") == "forward", has_source)
             .when(F.col("direction") == "backward", has_target)
             .when(F.col("direction") == "bidirectional", has_source | has_target)
             .otherwise(F.lit(False)))
    return (joined.withColumns({
        "connection_type": F.when(has_source & has_target, "full").otherwise("partial"),
        "source_confidence": g.confidence(F.col("source_distance"), max_distance),
        "target_confidence": g.confidence(F.col("target_distance"), max_distance)})
        .withColumns({"source": F.when(valid, F.col("source")),
                      "target": F.when(valid, F.col("target"))})
        .withColumns({f"{e}_confidence": F.when(F.col(f"{e}_distance").isNotNull(), F.col(f"{e}_confidence"))
                      for e in ("source", "target")})
        .select("drawing_id", "line_id", "direction", "source", "target", "source_distance",
                "target_distance", "connection_type", "source_confidence", "target_confidence"))


def symbols_at_ends(lines: DataFrame, symbols: DataFrame, max_distance: float = 50.0,
                    top: int = 10) -> DataFrame:
    """The nearest symbols of either end, start before end on equal distances."""
    hits = endpoint_symbols(lines, symbols, max_distance)
    # No more than `top` symbols of one point can be among the first of its line.
    nearest = Window.partitionBy("drawing_id", "px", "py").orderBy("distance", "symbol_id")
    few = hits.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= top).drop("_n")
    per_line = Window.partitionBy("drawing_id", "line_id").orderBy(
        "distance", "symbol_id", F.desc("endpoint"))
    return (line_endpoints(lines).join(large(few), ["drawing_id", "px", "py"])
            .withColumn("rank", F.row_number().over(per_line)).where(F.col("rank") <= top)
            .select("drawing_id", "line_id", "symbol_id", "endpoint", "distance", "rank"))


def near_endpoints(lines: DataFrame, distance: float) -> DataFrame:
    """Distinct positions of endpoints of one line type closer than the distance.

    (drawing_id, line_type, a_px, a_py, b_px, b_py), a before b or equal to it.
    Lines that share an endpoint share the row of its position.
    """
    return _near_points(line_endpoints(lines).select("drawing_id", "line_type", "px", "py").distinct(), distance)


def _near_points(points: DataFrame, distance: float) -> DataFrame:
    """Near pairs of (drawing_id, line_type, px, py, ...), all but the keys with prefixes a_ and b_."""
    names = [c for c in points.columns if c not in ("drawing_id", "line_type")]
    a, b = (points.withColumnsRenamed({c: prefix + c for c in names}) for prefix in ("a_", "b_"))
    point_a = g.Box(F.col("a_px"), F.col("a_py"), F.col("a_px"), F.col("a_py"))
    point_b = g.Box(F.col("b_px"), F.col("b_py"), F.col("b_px"), F.col("b_py"))
    near = g.point_distance(F.col("a_px"), F.col("a_py"), F.col("b_px"), F.col("b_py")) < distance
    return (pair_join(a, b, point_a, point_b, max(distance, 1), distance,
                      keys=["drawing_id", "line_type"])
            .where(near & ((F.col("a_px") < F.col("b_px"))
                           | ((F.col("a_px") == F.col("b_px")) & (F.col("a_py") <= F.col("b_py"))))))


def endpoint_links(lines: DataFrame, distance: float) -> DataFrame:
    """Links (drawing_id, a, b) that join same-type lines with near endpoints.

    Every position stands for its lowest line: as many links as lines and near
    positions, not as pairs of lines.
    """
    at = line_endpoints(lines)
    first = (at.groupBy("drawing_id", "line_type", "px", "py")
             .agg(F.min("line_id").alias("first_line")))
    here = at.join(large(first), ["drawing_id", "line_type", "px", "py"]).selectExpr(
        "drawing_id", "line_id a", "first_line b")
    across = _near_points(first, distance).selectExpr("drawing_id", "a_first_line a", "b_first_line b")
    return here.unionByName(across).where("a <> b").distinct()


# --- chains ------------------------------------------------------------------


def chain_hits(members: DataFrame, symbols: DataFrame, max_distance: float) -> DataFrame:
    """Symbols near any member of a chain, with their position on its path.

    Members are (drawing_id, chain_id, member_pos, start, x1 .. y2), where start
    is the length of the members before. A symbol is near when its centre is
    near the segment or its box near an endpoint. The position comes from the
    member closest to the centre, which lies within the distance plus half the
    diagonal of the box. Adds distance, first_member and pos.
    """
    size = max(2 * max_distance, 64.0)
    cx, cy = g.center(box())
    half = F.hypot((F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double")) / 2
    nodes = symbols.select("drawing_id", "symbol_id", cx.alias("cx"), cy.alias("cy"), half.alias("half"),
                           *(F.col(c).alias(f"s_{c}") for c in PLACE))
    reach = F.col("half") + max_distance
    area = g.Box(F.col("cx") - reach, F.col("cy") - reach, F.col("cx") + reach, F.col("cy") + reach)
    around = with_cells(nodes, area, size).drop("low_x", "low_y")
    line = members.select("drawing_id", "chain_id", "member_pos", "start", *PLACE)
    pieces = segment_cells(line, box(), size, 0.0)
    b = box("s_")
    to_center = g.point_segment_distance(F.col("cx"), F.col("cy"), box())
    to_ends = F.least(g.point_box_distance(F.col("x1"), F.col("y1"), b),
                      g.point_box_distance(F.col("x2"), F.col("y2"), b))
    t = g.segment_parameter(F.col("cx"), F.col("cy"), box())
    # Most pairs of a cell are told apart by plain comparisons; the pixel more makes up for rounding.
    edge = g.bounds(box())
    beside = (F.col("cx").between(edge.x1 - reach - 1, edge.x2 + reach + 1)
              & F.col("cy").between(edge.y1 - reach - 1, edge.y2 + reach + 1))
    # A pair may meet in several cells; minima do not mind.
    pairs = (pieces.join(large(around), CELL).where(beside)
             .withColumn("center_distance", to_center)
             .where(F.col("center_distance") <= reach)
             .withColumn("distance", F.least("center_distance", to_ends))
             .withColumn("pos", F.col("start") + t * g.segment_length(box())))
    near = F.col("distance") <= max_distance
    return (pairs.groupBy("drawing_id", "chain_id", "symbol_id")
            .agg(F.min(F.when(near, F.col("distance"))).alias("distance"),
                 F.min(F.when(near, F.col("member_pos"))).alias("first_member"),
                 F.min_by("pos", F.struct("center_distance", "member_pos")).alias("pos"))
            .where(F.col("distance").isNotNull()))


def path_positions(members: DataFrame, points: DataFrame, keys: list[str], size: float = 64) -> DataFrame:
    """Position of a point per chain: start of the closest member plus t times its length.

    A round looks at the members that come within a cell's side of the point's cell. A point whose closest
    one is no further than that side is served; the others wait for cells four times as large.
    """
    scratch = Scratch(members.sparkSession)
    offset = scratch.save(member_offsets(members, keys))
    waiting = scratch.save(points.select(*keys, "px", "py").distinct().join(large(offset.select(*keys).distinct()), keys, "left_semi"))
    found, cell = [], [*keys, "cell_x", "cell_y"]
    distance = g.point_segment_distance(F.col("px"), F.col("py"), box())
    pos = F.col("start") + g.segment_parameter(F.col("px"), F.col("py"), box()) * g.segment_length(box())
    while not waiting.isEmpty():  # sides grow beyond any distance
        asked = offset.join(large(waiting.select(*keys).distinct()), keys, "left_semi")
        pieces = segment_cells(asked.select(*keys, "member_pos", "start", *PLACE), box(), size, size)
        met = (point_cells(waiting, F.col("px"), F.col("py"), size).join(large(pieces), cell)
               .withColumn("_d", distance).where(F.col("_d") <= size))
        best = F.min_by(F.struct("member_pos", pos.alias("pos")), F.struct("_d", "member_pos"))
        served = scratch.save(met.groupBy(*keys, "px", "py").agg(best.alias("best")).select(*keys, "px", "py", "best.*"))
        found.append(served)
        waiting = scratch.save(waiting.join(large(served), [*keys, "px", "py"], "left_anti"))
        size *= 4
    if not found:
        return offset.join(large(points.select(*keys, "px", "py")), keys).select(*keys, "px", "py", "member_pos", F.col("start").alias("pos"))
    return reduce(DataFrame.unionByName, found)


def member_offsets(members: DataFrame, keys: list[str]) -> DataFrame:
    """Adds start, the summed length of the members before."""
    measured = members.withColumn("length", g.segment_length(box()))
    return with_sum_before(measured, keys, "member_pos", "length", "start")


def chain_summary(members: DataFrame) -> DataFrame:
    """Type, direction (the first that is not none) and overall line of each chain."""
    pos = F.col("member_pos")
    first, last = (lambda c: F.min_by(c, pos)), (lambda c: F.max_by(c, pos))
    given = F.when(F.col("direction") != "none", pos)
    return (members.groupBy("drawing_id", "chain_id").agg(
        first("line_type").alias("line_type"),
        F.coalesce(F.min_by("direction", given), F.lit("none")).alias("direction"),
        first("x1").alias("x1"), first("y1").alias("y1"),
        last("x2").alias("x2"), last("y2").alias("y2"))
        .withColumn("length", g.segment_length(box())))


def chain_links(members: DataFrame, symbols: DataFrame, max_distance: float) -> DataFrame:
    """Links between consecutive symbols of each chain, before removal of repeats.

    ``k`` is the place of the first symbol; distances stay in path order even
    where a backward chain swaps source and target.
    """
    return link_hits(chain_hits(members, symbols, max_distance), members, max_distance)


def link_hits(hits: DataFrame, members: DataFrame, max_distance: float) -> DataFrame:
    """The links of given hits, see chain_links."""
    placed = with_position(hits, ["drawing_id", "chain_id"],
                           ["pos", "first_member", "symbol_id"], "k")
    steps = with_successor(placed, ["drawing_id", "chain_id"], "k", ["symbol_id", "distance"])
    joined = (steps.where("symbol_id <> next_symbol_id")
              .join(large(chain_summary(members)), ["drawing_id", "chain_id"]))
    backward = F.col("direction") == "backward"
    return joined.select(
        "drawing_id", "chain_id", "k",
        F.when(backward, F.col("next_symbol_id")).otherwise(F.col("symbol_id")).alias("source"),
        F.when(backward, F.col("symbol_id")).otherwise(F.col("next_symbol_id")).alias("target"),
        F.col("line_type").alias("type"),
        F.when(backward, F.lit("forward")).otherwise(F.col("direction")).alias("direction"),
        *PLACE, "length",
        F.struct(
            F.col("distance").alias("source_distance"),
            F.col("next_distance").alias("target_distance"),
            F.lit("full").alias("connection_type"),
            F.col("direction").alias("direction_used"),
            g.confidence(F.col("distance"), max_distance).alias("source_confidence"),
            g.confidence(F.col("next_distance"), max_distance).alias("target_confidence"),
        ).alias("quality"))


def first_per_pair(links: DataFrame) -> DataFrame:
    """The first link of every undirected pair, without numbers."""
    names = [c for c in links.columns if c != "drawing_id"]
    first = F.min_by(F.struct(*names), F.struct("chain_id", "k")).alias("first")
    return (links.groupBy("drawing_id", F.least("source", "target").alias("_low"),
                          F.greatest("source", "target").alias("_high"))
            .agg(first).select("drawing_id", "first.*"))


def dedup_pairs(links: DataFrame) -> DataFrame:
    """First link of every undirected pair, ids renumbered from 0 per drawing."""
    return with_position(first_per_pair(links), ["drawing_id"], ["chain_id", "k"], "link_id")


def metadata(nodes: DataFrame, links: DataFrame, texts: DataFrame, lines: DataFrame,
             hits: DataFrame, chains: DataFrame, drawings: DataFrame) -> DataFrame:
    """The eight counters of a drawing. Hits are (drawing_id, chain_id, symbol_id)."""

    def counted(df: DataFrame, **aggregates) -> DataFrame:
        return df.groupBy("drawing_id").agg(*(v.alias(k) for k, v in aggregates.items()))

    everything = F.count("*")
    joined_chains = (hits.groupBy("drawing_id", "chain_id").count().where("count >= 2")
                     .select("drawing_id", "chain_id"))
    lonely = chains.select("drawing_id", "chain_id").join(
        large(joined_chains), ["drawing_id", "chain_id"], "left_anti")
    # Steps along a chain from a symbol to itself; hits are one row per chain and symbol, so two rows of one
    # symbol on a chain are such a step.
    loops = hits.groupBy("drawing_id", "chain_id", "symbol_id").count().where("count > 1")
    parts = [
        counted(loops, skipped_self_loops=F.sum(F.col("count") - 1)),
        counted(nodes.where("page = 0"), total_symbols=everything),
        counted(links, total_connections=everything, full_connections=everything),
        counted(texts, total_text_detections=everything),
        counted(lines, total_lines=everything,
                lines_with_direction=F.count_if(F.col("direction") != "none")),
        counted(lonely, skipped_no_partial_connection=everything),
    ]
    out = drawings.select("drawing_id").distinct()
    for part in parts:
        out = out.join(part, "drawing_id", "left")
    return out.na.fill(0)

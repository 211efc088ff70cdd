"""Whole runs: text and line clean-up, and the assembly of the graph."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetweave.functions import geometry as g
from sheetweave.functions.geometry import box
from sheetweave.operators import edits, filters, folds, graph, ink
from sheetweave.operators.foldrules import iou_above
from sheetweave.operators.joining import large
from sheetweave.operators.suppression import suppress
from sheetweave.scratch import Scratch
from sheetweave.sources import sinks

PLACE = ["x1", "y1", "x2", "y2"]


class Graph(NamedTuple):
    nodes: DataFrame
    links: DataFrame
    metadata: DataFrame


def assemble(symbols: DataFrame, texts: DataFrame, lines: DataFrame, header: DataFrame,
             detections: DataFrame | None = None, max_text_distance: float = 100.0,
             max_line_distance: float = 50.0) -> Graph:
    """Nodes, links and counters of every drawing.

    Header rows are (drawing_id, scale, resized_width), see graph.scale_symbols.
    Tables that several steps read are written once.
    """
    scratch = Scratch(symbols.sparkSession)
    if detections is not None:
        symbols = graph.override_boxes(symbols, detections)
    symbols = scratch.save(graph.scale_symbols(symbols, lines, header))
    assigned = graph.assign_texts(texts, symbols, max_text_distance)
    nodes = graph.build_nodes(symbols, assigned)
    members = scratch.save(folds.chain_lines(lines, max_line_distance))
    hits = scratch.save(graph.chain_hits(members, symbols, max_line_distance))
    links = scratch.save(graph.dedup_pairs(
        graph.link_hits(hits, members, max_line_distance)))
    drawings = symbols.select("drawing_id").unionByName(lines.select("drawing_id")).unionByName(
        texts.select("drawing_id"))
    counters = graph.metadata(nodes, links, texts, lines, hits, graph.chain_summary(members), drawings)
    return Graph(nodes, links, counters)


def clean_texts(found: DataFrame, pages: DataFrame, min_score: float = 0.22, iou_limit: float = 0.35) -> DataFrame:
    """From pooled recognised texts (drawing_id, text_id, x1 .. y2, text, score) to text items."""
    items = filters.confident(found, min_score)
    boxes = items.withColumnRenamed("text_id", "id")
    kept = suppress(boxes, iou_above(iou_limit)).selectExpr("drawing_id", "id text_id")
    valid = filters.valid_texts(items.join(large(kept), ["drawing_id", "text_id"], "left_semi"))
    close = folds.merge_close_texts(valid)
    return folds.merge_text_items(filters.plausible_text_boxes(close, pages), pages)


def pool_texts(found: DataFrame, pages: DataFrame, min_score: float = 0.22) -> DataFrame:
    """Texts found on tiles at several scales, on their pages.

    Found are (drawing_id, text_id, scale, x0, y0, x1 .. y2, text, score) with boxes in the pixels of a tile
    that begins at (x0, y0) of the scaled page; pages (drawing_id, width, height).
    """
    sized = filters.confident(found, min_score).join(pages.select("drawing_id", "width", "height"), "drawing_id")
    b = g.rescale_to_page(box(), F.col("x0"), F.col("y0"), F.col("scale"), F.col("width"), F.col("height"))
    pooled = sized.select("drawing_id", "text_id", *(c.alias(n) for c, n in zip(b, PLACE)), "text", "score")
    return pooled.where((g.width(box()) >= 3) & (g.height(box()) >= 3))


def clean_lines(segments: DataFrame, ink_runs: DataFrame, pages: DataFrame, texts: DataFrame | None = None,
                text_pad: int = 0, frames: DataFrame | None = None, symbols: DataFrame | None = None,
                caps: DataFrame | None = None) -> DataFrame:
    """From candidate segments and ink to merged solid lines.

    Segments, ink, pages, frames (contours, see ink.choose_frame) and symbols (components, see
    filters.symbol_contours) are in the pixels of the image that was searched; caps are (drawing_id,
    cap_scale, scale): that image is the page times both. Texts and the lines that come back are on the page. With
    frames the notes block and all outside of the frame go, then the texts, then the symbols. What an
    erasure leaves is written: the next step reads it twice, and the plan would double with each.
    """
    scratch = Scratch(segments.sparkSession)
    factor = F.lit(1.0)
    if caps is not None:
        pages = pages.join(caps, "drawing_id")
        factor = F.col("cap_scale") * F.col("scale")
    if frames is not None:
        framed = ink.choose_frame(frames, pages.select("drawing_id", "width", "height"))
        ink_runs = ink.keep_area(ink_runs, pages, framed)
    if texts is not None:
        sized = texts.join(pages, "drawing_id")
        place = lambda c, by, size: F.greatest(F.lit(0), F.least(
            F.bround((F.col(c) + by) * factor).cast("bigint"), F.col(size) - 1)).alias(c)
        ink_runs = scratch.save(ink.erase(ink_runs, sized.select(
            "drawing_id", place("x1", -text_pad, "width"), place("y1", -text_pad, "height"),
            place("x2", text_pad, "width"), place("y2", text_pad, "height"))))
    if symbols is not None:
        areas = filters.symbol_contours(symbols).selectExpr("drawing_id", "x1", "y1", "x2 - 1 x2", "y2 - 1 y2")
        before, ink_runs = ink_runs, scratch.save(ink.erase(ink_runs, areas))
        scratch.forget(before)
    solid = ink.solid_lines(segments, ink_runs, pages)
    if caps is not None:
        on_page = g.unscale(box(), 1 / F.col("scale"), 1 / F.col("cap_scale"))
        solid = solid.join(caps, "drawing_id").withColumns(dict(zip(PLACE, on_page))).drop("cap_scale", "scale")
    return folds.merge_segments(scratch.save(solid))  # the fold reads its items twice


def digitize(found_texts: DataFrame, segments: DataFrame, ink_runs: DataFrame, symbols: DataFrame, header: DataFrame,
             pages: DataFrame, searched: DataFrame, caps: DataFrame, frames: DataFrame, components: DataFrame,
             directions: DataFrame | None = None, text_pad: int = 2, max_text_distance: float = 100.0,
             max_line_distance: float = 50.0) -> Graph:
    """The whole way from what was detected to the graph: texts pooled and cleaned, lines cleaned on the
    ink that is left, given the directions (drawing_id, line_id, seq, value) that were set by hand, and
    everything assembled. Pages are those of texts and symbols, ``searched`` those of the segments."""
    scratch = Scratch(symbols.sparkSession)
    texts = scratch.save(clean_texts(pool_texts(found_texts, pages), pages))
    merged = clean_lines(segments, ink_runs, searched, texts, text_pad, frames, components, caps)
    lines = merged.withColumns({"line_type": F.lit("solid"), "direction": F.lit("none")})
    if directions is not None:
        lines = edits.set_directions(lines, directions)
    return assemble(symbols, texts, scratch.save(lines), header, None, max_text_distance, max_line_distance)


def documents(graph_: Graph) -> tuple[DataFrame, DataFrame]:
    """The full and the compact document of every drawing."""
    scratch = Scratch(graph_.nodes.sparkSession)
    nodes, links = scratch.save(graph_.nodes), scratch.save(graph_.links)
    return sinks.full_graph(nodes, links, graph_.metadata), sinks.compact_graph(nodes, links)

"""Row filters over detections, texts, components and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetweave.functions import geometry as g
from sheetweave.functions import textrules
from sheetweave.functions.geometry import box
from sheetweave.operators.joining import large
from sheetweave.operators.spatial import with_cells, segment_cells

PLACE = ["x1", "y1", "x2", "y2"]


def confident(df: DataFrame, threshold: float) -> DataFrame:
    return df.where(F.col("score") >= threshold)


def valid_texts(texts: DataFrame) -> DataFrame:
    return texts.where(textrules.is_valid_text(F.col("text"), g.area(box())))


def plausible_text_boxes(texts: DataFrame, pages: DataFrame, page_scale: float = 1.0) -> DataFrame:
    """Without tiny, stretched, page-filling and doubtful boxes."""
    b = box()
    w, h = g.width(b), g.height(b)
    page_area = F.col("width") * page_scale * F.col("height") * page_scale
    joined = texts.join(pages.select("drawing_id", "width", "height"), "drawing_id")
    bad = (((w < 28) & (h < 14))
           | (w / F.greatest(F.lit(1), h) > 20) | (h / F.greatest(F.lit(1), w) > 20)
           | (w * h > 0.02 * page_area) | (F.col("score") < 0.25))
    return joined.where(~bad).drop("width", "height")


def without_junk(texts: DataFrame) -> DataFrame:
    """After merging: no blanks, no single signs, no small doubtful texts."""
    t = textrules.strip(F.col("text"))
    bad = ((t == "") | ((F.length(t) == 1) & ~t.rlike(r"[\p{L}\p{N}]"))
           | ((g.clamped_area(box()) < 120) & (F.col("score") < 0.5)))
    return texts.where(~bad)


def spoken_texts(texts: DataFrame) -> DataFrame:
    return texts.where(textrules.strip(F.col("text")) != "")


def mask_area_between(features: DataFrame, low: int = 100, high: int = 50_000) -> DataFrame:
    return features.where(F.col("area").between(low, high))


def long_enough(lines: DataFrame, minimum: float) -> DataFrame:
    return lines.where(g.segment_length(box()) >= minimum)


def uncovered_lines(lines: DataFrame, texts: DataFrame, symbols: DataFrame, pad: int = 10,
                    text_share: float = 0.15, symbol_share: float = 0.20) -> DataFrame:
    """Lines that no padded text or symbol box covers to its share."""
    def boxes(df: DataFrame, limit: float) -> DataFrame:
        return df.select("drawing_id", *(F.col(c).alias(f"b_{c}") for c in PLACE),
                         F.lit(limit).alias("limit"))

    covers = boxes(texts, text_share).unionByName(boxes(symbols, symbol_share)).distinct()
    spread = with_cells(covers, box("b_"), 128, pad).drop("low_x", "low_y")
    pieces = segment_cells(lines.select("drawing_id", "line_id", *PLACE), box(), 128, 0.0)
    # A pair may meet in several cells; for the anti join that is all the same.
    covered = (pieces.join(large(spread), ["drawing_id", "cell_x", "cell_y"])
               .where(g.boxes_touch(g.bounds(box()), g.grow(box("b_"), pad)))
               .where(g.cover_share(box(), g.grow(box("b_"), pad)) >= F.col("limit")))
    return lines.join(large(covered.select("drawing_id", "line_id")), ["drawing_id", "line_id"], "left_anti")


def component_segments(components: DataFrame, orientation: Column, min_length: int = 12,
                       min_area: int = 6) -> DataFrame:
    """Middle line of components (x, y, w, h, area), flat or upright."""
    flat = orientation == "h"
    mid_y = (F.col("y") + F.col("h") / 2).cast("bigint")
    mid_x = (F.col("x") + F.col("w") / 2).cast("bigint")
    extent = F.when(flat, F.col("w")).otherwise(F.col("h"))
    return components.where((F.col("area") >= min_area) & (extent >= min_length)).withColumns({
        "x1": F.when(flat, F.col("x")).otherwise(mid_x),
        "y1": F.when(flat, mid_y).otherwise(F.col("y")),
        "x2": F.when(flat, F.col("x") + F.col("w")).otherwise(mid_x),
        "y2": F.when(flat, mid_y).otherwise(F.col("y") + F.col("h"))})


def symbol_contours(components: DataFrame, min_area: int = 600, max_side: int = 260,
                    max_aspect: float = 2.8, dilate: int = 10) -> DataFrame:
    """Contour boxes (x, y, w, h) of symbol shape; the dilated area as x1 .. y2.

    The drawn rectangle includes its far edges; a square kernel of even size
    spreads one pixel less to the left and up than to the right and down.
    """
    longer, shorter = F.greatest("w", "h"), F.least("w", "h")
    before, after = max(dilate - 1 - dilate // 2, 0), dilate // 2 + 1
    return (components.where((F.col("w") * F.col("h") >= min_area) & (longer <= max_side)
                             & (longer / (shorter + 1e-6) <= max_aspect))
            .withColumns({"x1": F.col("x") - before, "y1": F.col("y") - before,
                          "x2": F.col("x") + F.col("w") + after, "y2": F.col("y") + F.col("h") + after}))


def symbol_boxes(components: DataFrame, pages: DataFrame, min_area: int = 60,
                 max_area: int = 50_000) -> DataFrame:
    """Components (x, y, w, h, area) of plausible size that do not span the page."""
    return (components.join(pages.select("drawing_id", "width", "height"), "drawing_id")
            .where(F.col("area").between(min_area, max_area)
                   & (F.col("w") <= 0.8 * F.col("width")) & (F.col("h") <= 0.8 * F.col("height")))
            .drop("width", "height"))


def compact_blobs(components: DataFrame, runs: DataFrame, min_area: int = 1200,
                  max_aspect: float = 2.2, max_side: int = 220, min_extent: float = 0.25,
                  max_touch: float = 0.10, band: int = 2) -> DataFrame:
    """Components that are symbol blobs: compact, filled, not running into their edges.

    Components are (drawing_id, mask_id, x1 .. y2, area, has_long_line); the runs
    of a component give its pixels in the outer band of each side.
    """
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    chosen = components.where(
        (F.col("area") >= min_area)
        & (F.greatest(w, h) / F.greatest(F.lit(1), F.least(w, h)) <= max_aspect)
        & (F.greatest(w, h) <= max_side)
        & (F.col("area") / F.greatest(F.lit(1), w * h) >= min_extent) & ~F.col("has_long_line"))
    length = F.col("x_end") - F.col("x_start")
    left = F.greatest(F.lit(0), F.least(F.col("x_end"), F.col("x1") + band) - F.col("x_start"))
    right = F.greatest(F.lit(0), F.col("x_end") - F.greatest(F.col("x_start"), F.col("x2") - band))
    zero = F.lit(0)
    key = ["drawing_id", "mask_id"]
    edges = (runs.join(large(chosen.select(*key, *PLACE)), key).groupBy(*key).agg(
        F.greatest(F.sum(F.when(F.col("y") < F.col("y1") + band, length).otherwise(zero)),
                   F.sum(F.when(F.col("y") >= F.col("y2") - band, length).otherwise(zero)),
                   F.sum(left), F.sum(right)).alias("touch")))
    return (chosen.join(large(edges), key)
            .where(F.col("touch") / F.greatest(F.lit(1), F.col("area")) <= max_touch))


def discard_split(symbols: DataFrame, exempt: list[str] | None = None) -> DataFrame:
    """Adds discarded: whether the category is one to be left out."""
    return symbols.withColumn("discarded", textrules.is_discarded(F.col("category"), exempt))


def list_search(rows: DataFrame, shown: Column, needle: str) -> DataFrame:
    """Rows whose listed form holds the needle, whatever its case."""
    return rows.withColumn("shown", shown).where(F.contains(F.lower("shown"), F.lit(needle.lower())))

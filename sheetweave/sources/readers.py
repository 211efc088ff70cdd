"""JSON documents of drawings as tables.

Documents are rows (drawing_id, value). They may come from one file per drawing
or from any table; parsing is the same. Entries of two forms in one list are
read as VARIANT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings of the file names of the stages, cut off to get the drawing.
SUFFIXES = ["_sam2_results", "_classification", "_step1", "_step2_boxes", "_step3_text",
            "_step4_lines", "_digitized_llm", "_digitized", "_points"]

DETECTIONS = """image_path STRING, num_masks BIGINT, processing_params MAP<STRING, STRING>,
    masks_info ARRAY<STRUCT<id: BIGINT, score: DOUBLE, area: BIGINT, bbox: ARRAY<DOUBLE>,
    prompt_point: ARRAY<DOUBLE>, prompt_box: ARRAY<DOUBLE>>>"""
SYMBOLS = """symbols ARRAY<STRUCT<id: BIGINT, mask_id: BIGINT, bbox: ARRAY<DOUBLE>, area: BIGINT,
    cluster_id: BIGINT, category: STRING, confidence: DOUBLE, embedding: ARRAY<FLOAT>>>"""
OCR = """boxes ARRAY<ARRAY<DOUBLE>>, scores ARRAY<DOUBLE>, texts ARRAY<STRING>,
    quads ARRAY<ARRAY<ARRAY<DOUBLE>>>"""


def documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file; the drawing is the partition folder or the file name."""
    files = spark.read.text(path, wholetext=True)
    if "drawing_id" in files.columns:
        return files.select("drawing_id", "value")
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    stem = F.regexp_replace(name, "(" + "|".join(SUFFIXES) + ")$", "")
    return files.select(stem.alias("drawing_id"), "value")


def _corners(bbox: Column | str) -> list[Column]:
    bbox = F.col(bbox) if isinstance(bbox, str) else bbox
    return [F.get(bbox, i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]


def _variant(value: str, path: str, kind: str) -> Column:
    return F.expr(f"try_variant_get({value}, '{path}', '{kind}')")


def parse_detections(docs: DataFrame) -> DataFrame:
    """Detections; entries without an id or a box are left out."""
    rows = docs.select("drawing_id", F.explode(F.from_json("value", DETECTIONS)["masks_info"]).alias("m"))
    return rows.where("m.id IS NOT NULL AND size(m.bbox) = 4").select(
        "drawing_id", F.col("m.id").alias("det_id"), "m.score", "m.area", *_corners("m.bbox"),
        F.coalesce("m.prompt_point", "m.prompt_box").alias("prompt"))


def parse_runs(docs: DataFrame) -> DataFrame:
    """Headers of the detection runs."""
    head = F.from_json("value", DETECTIONS)
    return docs.select("drawing_id", head["image_path"].alias("image_path"),
                       head["num_masks"].alias("num_masks"), head["processing_params"].alias("params"))


def parse_texts(docs: DataFrame, wrapped: bool = True, keep_blank: bool = False) -> DataFrame:
    """Text items of a list, or of the list under ``detections`` where that is accepted."""
    parsed = docs.select("drawing_id", F.expr("try_parse_json(value)").alias("v"))
    items = _variant("v", "$", "array<variant>")
    if wrapped:
        items = F.coalesce(_variant("v", "$.detections", "array<variant>"), items)
    rows = parsed.select("drawing_id", F.posexplode(items).alias("text_id", "e"))
    out = rows.select(
        "drawing_id", F.col("text_id").cast("bigint").alias("text_id"),
        *_corners(_variant("e", "$.bbox", "array<double>")),
        F.coalesce(_variant("e", "$.text", "string"), F.lit("")).alias("text"),
        F.coalesce(_variant("e", "$.confidence", "double"), _variant("e", "$.score", "double"),
                   F.lit(1.0)).alias("score"))
    return out if keep_blank else out.where("trim(text) <> ''")


def parse_lines(docs: DataFrame) -> DataFrame:
    """Lines of both types, solid before dashed; entries are lists or {line, direction}."""
    parsed = docs.select("drawing_id", F.expr("try_parse_json(value)").alias("v")).select(
        "drawing_id", *(F.coalesce(_variant("v", f"$.{t}", "array<variant>"),
                                   F.expr("CAST(array() AS ARRAY<VARIANT>)")).alias(t)
                        for t in ("solid", "dashed")))

    entries = F.concat(
        F.transform("solid", lambda e, i: F.struct(F.lit("solid").alias("line_type"), i.alias("line_id"), e.alias("e"))),
        F.transform("dashed", lambda e, i: F.struct(F.lit("dashed").alias("line_type"),
                                                    (F.size("solid") + i).alias("line_id"), e.alias("e"))))
    rows = parsed.select("drawing_id", F.inline(entries))
    line = F.coalesce(_variant("e", "$.line", "array<double>"), _variant("e", "$", "array<double>"))
    return rows.select(
        "drawing_id", F.col("line_id").cast("bigint").alias("line_id"), "line_type",
        F.coalesce(_variant("e", "$.direction", "string"), F.lit("none")).alias("direction"), *_corners(line))


def parse_line_header(docs: DataFrame) -> DataFrame:
    """(drawing_id, image_path, target_width, scale, resized_height, resized_width)."""
    v = docs.select("drawing_id", F.expr("try_parse_json(value)").alias("v"))
    return v.select(
        "drawing_id", _variant("v", "$.image_path", "string").alias("image_path"),
        _variant("v", "$.target_width", "bigint").alias("target_width"),
        _variant("v", "$.scale", "double").alias("scale"),
        _variant("v", "$.resized_shape[0]", "bigint").alias("resized_height"),
        _variant("v", "$.resized_shape[1]", "bigint").alias("resized_width"))


def parse_symbols(docs: DataFrame) -> DataFrame:
    """Classified symbols; the id is the place in the list, those without a box are left out."""
    rows = docs.select("drawing_id",
                       F.posexplode(F.from_json("value", SYMBOLS)["symbols"]).alias("pos", "s"))
    return rows.where("size(s.bbox) = 4").select(
        "drawing_id", F.col("pos").cast("bigint").alias("symbol_id"), "s.mask_id", *_corners("s.bbox"),
        "s.area", "s.cluster_id", F.coalesce("s.category", F.lit("unknown")).alias("category"),
        "s.confidence", "s.embedding")


def parse_ocr(docs: DataFrame) -> DataFrame:
    """Parallel arrays of recognised texts as rows."""
    o = F.from_json("value", OCR)
    zipped = F.arrays_zip(o["boxes"].alias("boxes"), o["scores"].alias("scores"),
                          o["texts"].alias("texts"), o["quads"].alias("quads"))
    rows = docs.select("drawing_id", F.posexplode(zipped).alias("idx", "z"))
    return rows.select("drawing_id", F.col("idx").cast("bigint").alias("idx"), *_corners("z.boxes"),
                       F.col("z.scores").alias("score"), F.col("z.texts").alias("text"),
                       F.col("z.quads").alias("quad"))


def parse_annotations(docs: DataFrame, first_box: bool = False) -> DataFrame:
    """Ragged annotation rows: a list of four numbers is the box, a text the type.

    The last box of a row holds, or the first one; of texts the last that is not
    an id. Rows without a box are left out.
    """
    rows = docs.select("drawing_id", F.posexplode(F.expr(
        "try_variant_get(try_parse_json(value), '$', 'array<variant>')")).alias("ann_id", "row"))
    cells = rows.select("drawing_id", "ann_id", _variant("row", "$", "array<variant>").alias("cells"))
    parts = cells.select(
        "drawing_id", F.col("ann_id").cast("bigint").alias("ann_id"),
        F.expr("filter(transform(cells, c -> try_variant_get(c, '$', 'array<double>')),"
               " b -> size(b) = 4)").alias("boxes"),
        F.expr("filter(transform(filter(cells, c -> schema_of_variant(c) = 'STRING'),"
               " c -> variant_get(c, '$', 'string')), t -> NOT startswith(t, 'symbol_'))").alias("names"))
    chosen = F.element_at("boxes", 1 if first_box else -1)
    return parts.where("size(boxes) > 0").select(
        "drawing_id", "ann_id", *_corners(chosen),
        F.when(F.size("names") > 0, F.element_at("names", -1)).alias("symbol_type"))

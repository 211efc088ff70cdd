"""Tables as JSON documents and label files.

A document holds at most ``part_size`` entries of a list, by their place in it; a drawing
with more has further parts, each a document of its own (counters are in the first).
So ordinary drawings get the one document they are expected to have, and no task
assembles a huge one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetweave.functions import geometry as g
from sheetweave.functions.geometry import box
from sheetweave.operators.joining import large

PART_SIZE = 50_000
KEY = ["drawing_id", "part"]
KEEP_NULLS = {"ignoreNullFields": "false"}


def write_documents(docs: DataFrame, path: str) -> None:
    """One file per drawing and part; written again, only these drawings are replaced."""
    (docs.select("drawing_id", "part", "value").repartition(*KEY)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*KEY).text(path))


#: Files of a packed store of documents.
BUCKETS = 64


def _bucket(drawing: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(drawing.cast("string")), F.lit(buckets)).cast("int")


def write_packed(docs: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Documents (drawing_id, part, value) in a bounded number of files, whatever the number of drawings.

    A drawing's place follows from the hash of its id, and files are sorted by it; their column
    statistics are the index. Written again, all is replaced.
    """
    (docs.select("drawing_id", "part", "value", _bucket(F.col("drawing_id"), buckets).alias("bucket"))
     .repartition(buckets, "bucket").sortWithinPartitions("bucket", *KEY)
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/of={buckets}"))


def read_packed(spark: SparkSession, path: str, drawing=None, buckets: int = BUCKETS) -> DataFrame:
    """All documents of a packed store, or those of one drawing: its bucket is read alone, and of
    that only the row groups whose range of ids has the drawing."""
    docs = spark.read.parquet(f"{path}/of={buckets}")
    if drawing is not None:
        docs = docs.where((F.col("bucket") == _bucket(F.lit(drawing), buckets)) & (F.col("drawing_id") == F.lit(drawing)))
    return docs.select("drawing_id", "part", "value")


def bbox_array(b=None) -> Column:
    return F.array(*(b or box()))


def _with_part(rows: DataFrame, order: list, part_size: int) -> DataFrame:
    """Adds the part by the place of a row in its drawing, whatever the ids are.

    Rows are counted and numbered within ranges of ids, which are of bounded size, and
    the counts of the ranges before are added.
    """
    ranged = rows.withColumn("_range", F.floor(F.col(order[0]) / part_size))
    earlier = Window.partitionBy("drawing_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("drawing_id", "_range").agg(F.count("*").alias("_n")).select(
        "drawing_id", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("drawing_id", "_range").orderBy(*order)
    place = F.col("_before") + F.row_number().over(inside) - 1
    return (ranged.join(large(before), ["drawing_id", "_range"])
            .withColumn("part", F.floor(place / part_size)).drop("_range", "_before"))


def _listed(rows: DataFrame, order: list, entry: Column, name: str, part_size: int) -> DataFrame:
    """JSON list of the entries of each part, in order; the first order column is the number."""
    ordered = F.sort_array(F.collect_list(F.struct(*order, "_entry")))
    listed = rows.select("drawing_id", *order, entry.alias("_entry"))
    return _with_part(listed, order, part_size).groupBy("drawing_id", "part").agg(
        F.concat(F.lit("["), F.array_join(ordered["_entry"], ","), F.lit("]")).alias(name))


def _list_or_empty(name: str) -> Column:
    return F.coalesce(name, F.lit("[]"))


def full_graph(nodes: DataFrame, links: DataFrame, metadata: DataFrame,
               part_size: int = PART_SIZE) -> DataFrame:
    """Documents with all nodes, links and counters."""
    detail = F.transform("nearby", lambda d: F.struct(
        d["text"].alias("text"), d["distance"].alias("distance"),
        F.array(*(d["bbox"][c] for c in ("x1", "y1", "x2", "y2"))).alias("bbox"),
        d["confidence"].alias("confidence")))
    node = [F.col("symbol_id").alias("id"), F.col("category"), bbox_array().alias("bbox"), F.col("area"),
            F.col("captions"), detail.alias("nearby_text_details"), F.col("confidence"),
            F.col("cluster_id"), F.col("mask_id"), F.col("symbol_id").alias("original_index")]
    # Only a node with very many captions has further pages.
    entry = F.when(F.col("page") == 0, F.to_json(F.struct(*node), KEEP_NULLS)).otherwise(
        F.to_json(F.struct(*node, "page"), KEEP_NULLS))
    link = F.to_json(F.struct(
        F.col("link_id").alias("id"), "source", "target", "type", "direction",
        bbox_array().alias("line"), "length", F.col("quality").alias("connection_quality")), KEEP_NULLS)
    counters = F.to_json(F.struct(*(c for c in metadata.columns if c != "drawing_id")))
    head = metadata.select("drawing_id", F.lit(0).cast("bigint").alias("part"), counters.alias("metadata"))
    return (head.join(_listed(nodes, ["symbol_id", "page"], entry, "nodes", part_size), KEY, "full")
            .join(_listed(links, ["link_id"], link, "links", part_size), KEY, "full")
            .select(*KEY, F.concat(
                F.lit('{"nodes":'), _list_or_empty("nodes"), F.lit(',"links":'), _list_or_empty("links"),
                F.lit(',"metadata":'), F.coalesce("metadata", F.lit("null")), F.lit("}")).alias("value")))


def compact_graph(nodes: DataFrame, links: DataFrame | None = None, part_size: int = PART_SIZE) -> DataFrame:
    """Documents with categories, captions and ends only, for language models."""
    page = F.when(F.col("page") > 0, F.col("page")).alias("page")
    node = F.to_json(F.struct(F.col("symbol_id").alias("id"), "category", "captions", page))
    docs = _listed(nodes, ["symbol_id", "page"], node, "nodes", part_size)
    if links is None:
        docs = docs.withColumn("links", F.lit(None).cast("string"))
    else:
        both = F.when(F.col("quality.direction_used") == "bidirectional", True).alias("bidirectional")
        link = F.to_json(F.struct(F.col("source").alias("from"), F.col("target").alias("to"), "type", both))
        docs = docs.join(_listed(links, ["link_id"], link, "links", part_size), KEY, "full")
    return docs.select(*KEY, F.concat(F.lit('{"nodes":'), _list_or_empty("nodes"), F.lit(',"links":'),
                                      _list_or_empty("links"), F.lit("}")).alias("value"))


def results(detections: DataFrame, headers: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """Detection results. Headers are (drawing_id, image_path, params MAP).

    The prompt goes under prompt_point or prompt_box by its length.
    """
    prompt = F.col("prompt") if "prompt" in detections.columns else F.lit(None).cast("array<bigint>")
    entry = F.to_json(F.struct(
        F.col("det_id").alias("id"), "score", "area", bbox_array().alias("bbox"),
        F.when(F.size(prompt) == 2, prompt).alias("prompt_point"),
        F.when(F.size(prompt) == 4, prompt).alias("prompt_box")))
    count = detections.groupBy("drawing_id").agg(F.count("*").alias("num_masks"))
    head = headers.join(count, "drawing_id").select("drawing_id", F.to_json(F.struct(
        "image_path", "num_masks", F.col("params").alias("processing_params"))).alias("head"))
    return (_listed(detections, ["det_id"], entry, "masks", part_size).join(large(head), "drawing_id")
            .select(*KEY, F.concat(F.expr("left(head, length(head)-1)"), F.lit(',"masks_info":'),
                                   F.col("masks"), F.lit("}")).alias("value")))


def classification(symbols: DataFrame, headers: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """Classified symbols, valid and discarded ones apart, with counts.

    Symbols are those of filters.discard_split; headers (drawing_id, image_path).
    """
    embedding = F.col("embedding") if "embedding" in symbols.columns else F.lit(None).cast("array<float>")
    entry = F.to_json(F.struct(
        F.col("symbol_id").alias("id"), "mask_id", bbox_array().alias("bbox"),
        F.array(g.width(box()), g.height(box())).alias("size"), g.area(box()).alias("area"),
        "cluster_id", "category", embedding.alias("embedding")))
    valid = _listed(symbols.where("NOT discarded"), ["symbol_id"], entry, "valid", part_size)
    dropped = _listed(symbols.where("discarded"), ["symbol_id"], entry, "dropped", part_size)
    counts = symbols.groupBy("drawing_id", "category").agg(
        F.count("*").alias("n"), F.bool_or("discarded").alias("discarded"))
    # Symbols without a label count as a category, although they are discarded.
    named = F.col("discarded") & (F.col("category") != "unlabeled")

    def per_category(kept: Column) -> Column:
        pairs = F.collect_list(F.when(kept, F.struct("category", "n")))
        return F.map_from_entries(F.sort_array(pairs))

    totals = counts.groupBy("drawing_id").agg(
        F.sum("n").alias("num_symbols_detected"), per_category(~named).alias("categories"),
        per_category(named).alias("discarded_categories"),
        F.sum(F.when(~F.col("discarded"), F.col("n")).otherwise(0)).alias("num_symbols_valid"),
        F.sum(F.when(F.col("discarded"), F.col("n")).otherwise(0)).alias("num_symbols_discarded"))
    clusters = symbols.groupBy("drawing_id").agg(
        F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("num_clusters"))
    head = headers.join(totals, "drawing_id").join(clusters, "drawing_id").select(
        "drawing_id", F.to_json(F.struct(
            "image_path", "num_symbols_detected", "num_clusters", "categories", "discarded_categories",
            "num_symbols_valid", "num_symbols_discarded")).alias("head"))
    return (valid.join(dropped, KEY, "full").join(large(head), "drawing_id")
            .select(*KEY, F.concat(
                F.expr("left(head, length(head)-1)"), F.lit(',"symbols":'), _list_or_empty("valid"),
                F.lit(',"discarded_symbols":'), _list_or_empty("dropped"), F.lit("}")).alias("value")))


def prompt_points(detections: DataFrame, headers: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """Box centres as positive prompts. Headers are (drawing_id, image_path)."""
    cx, cy = g.center(box())
    center = F.to_json(F.array(cx, cy))
    entry = F.to_json(F.struct(F.array(cx, cy).alias("center"), F.col("score").alias("confidence"),
                               bbox_array().alias("bbox")))
    points = _listed(detections, ["det_id"], center, "points", part_size)
    rows = _listed(detections, ["det_id"], entry, "rows", part_size)
    total = detections.groupBy("drawing_id").agg(F.count("*").alias("num_detections"))
    head = headers.join(total, "drawing_id").select(
        "drawing_id", F.to_json(F.struct("image_path", "num_detections")).alias("head"))
    return (points.join(large(rows), KEY).join(large(head), "drawing_id")
            .select(*KEY, F.concat(
                F.expr("left(head, length(head)-1)"), F.lit(',"sam2_prompts":{"points":'), F.col("points"),
                F.lit(',"labels":'), F.to_json(F.array_repeat(F.lit(1), F.json_array_length("points"))),
                F.lit('},"detections":'), F.col("rows"), F.lit("}")).alias("value")))


def combined_points(docs: DataFrame) -> DataFrame:
    """The documents of all drawings under their names, one entry per line."""
    name = F.regexp_extract(F.to_json(F.array(F.col("drawing_id").cast("string"))), r"^\[(.*)\]$", 1)
    return docs.select(F.concat(F.lit("{"), name, F.lit(":"), F.col("value"), F.lit("}")).alias("value"))


def label_files(annotations: DataFrame, pages: DataFrame, splits: DataFrame,
                part_size: int = PART_SIZE) -> DataFrame:
    """Label text per drawing: class 0, centre and size relative to the page.

    Annotations are (drawing_id, ann_id, x1 .. y2); returns (split, drawing_id, part, value).
    """
    parts = g.normalised_center_size(box(), F.col("width"), F.col("height"))
    rows = annotations.join(pages.select("drawing_id", "width", "height"), "drawing_id").select(
        "drawing_id", "ann_id", F.format_string("0 %.6f %.6f %.6f %.6f", *parts).alias("label"))
    ordered = F.sort_array(F.collect_list(F.struct("ann_id", "label")))
    text = _with_part(rows, ["ann_id"], part_size).groupBy("drawing_id", "part").agg(
        F.array_join(ordered["label"], "\n").alias("value"))
    return text.join(splits.select("drawing_id", "split"), "drawing_id").select("split", *KEY, "value")


def write_labels(labels: DataFrame, path: str) -> None:
    """Label files below one folder per split, and the short dataset description beside them."""
    key = ["split", "drawing_id", "part"]
    labels.repartition(*key).write.mode("overwrite").partitionBy(*key).text(f"{path}/labels")
    lines = [f"path: {path}", "train: images/train", "val: images/val", "names:", "  0: symbol", "nc: 1"]
    spark = labels.sparkSession
    (spark.createDataFrame([("\n".join(lines),)], "value string")
     .write.mode("overwrite").text(f"{path}/dataset"))

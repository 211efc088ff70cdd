"""Drawing tables derived from the driver tables by integer arithmetic.

The expressions are plain SQL that Spark and DuckDB evaluate alike, so the same
text serves as input of the queries and as common table expressions of the
oracle statements. The number of drawings grows with the driver tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOLS = """
SELECT CAST(floor(p_partkey/100) AS BIGINT) drawing_id, p_partkey%100 symbol_id,
  (p_partkey*7919)%1400 x1, (p_partkey*104729)%900 y1,
  (p_partkey*7919)%1400+10+(p_partkey*31)%60 x2, (p_partkey*104729)%900+10+(p_partkey*17)%60 y2,
  ((p_partkey*37)%1000)/CAST(1000 AS DOUBLE) score, p_type category
FROM part"""

DETECTIONS = """
SELECT drawing_id, symbol_id*3+k det_id, x1+k*(symbol_id%9) x1, y1+k*(symbol_id%7) y1,
  x2+k*(symbol_id%9) x2, y2+k*(symbol_id%7) y2,
  ((symbol_id*37+k*411+drawing_id*13)%1000)/CAST(1000 AS DOUBLE) score
FROM {copies}"""
COPIES_DUCKDB = "(SELECT *, unnest([0::BIGINT, 1, 2]) k FROM symbols_v) q"
COPIES_SPARK = "symbols_v LATERAL VIEW explode(array(0L, 1L, 2L)) q AS k"

TEXTS = """
SELECT CAST(floor(c_custkey/75) AS BIGINT) drawing_id, c_custkey%75 text_id,
  CASE c_custkey%7 WHEN 0 THEN concat('V', 1000+c_custkey%1000, 'A') WHEN 1 THEN 'FO'
    WHEN 2 THEN concat(' MAIN  STEAM ', c_custkey) WHEN 3 THEN '--' WHEN 4 THEN 'a'
    WHEN 5 THEN '32' ELSE 'INSIDE CONTAINMENT' END "text",
  (c_custkey*6151)%1400 x1, (c_custkey*3571)%900 y1,
  (c_custkey*6151)%1400+4+(c_custkey*13)%90 x2, (c_custkey*3571)%900+6+(c_custkey*7)%20 y2,
  ((c_custkey*53)%1000)/CAST(1000 AS DOUBLE) score
FROM customer"""

LINES = """
SELECT CAST(floor(o_orderkey/750) AS BIGINT) drawing_id,
  CAST(floor((o_orderkey%750)/5) AS BIGINT) line_id,
  CASE WHEN o_orderkey%3=0 THEN 'dashed' ELSE 'solid' END line_type,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'forward' WHEN '2-HIGH' THEN 'backward'
    WHEN '3-MEDIUM' THEN 'bidirectional' ELSE 'none' END direction,
  (o_orderkey*911)%1400 x1, (o_orderkey*577)%900 y1,
  (o_orderkey*911)%1400+CASE WHEN o_orderkey%2=0 THEN 40+(o_orderkey*29)%300 ELSE o_orderkey%4 END x2,
  (o_orderkey*577)%900+CASE WHEN o_orderkey%2=0 THEN o_orderkey%4 ELSE 40+(o_orderkey*29)%300 END y2
FROM orders WHERE o_orderkey%5=0"""

DRAWINGS = """
SELECT drawing_id, CAST(7168 AS BIGINT) target_width, 1400+(drawing_id*37)%600 width,
  900+(drawing_id*53)%400 height
FROM (SELECT DISTINCT drawing_id FROM symbols_v) q"""

EDITS = """
SELECT user_id%20 drawing_id, event_id seq,
  CASE event_type WHEN 'click' THEN 'delete' WHEN 'view' THEN 'undo' WHEN 'error' THEN 'redo'
    WHEN 'signup' THEN 'set_direction' ELSE 'combine' END op,
  (event_id*31)%100 target_a, (event_id*17+1)%100 target_b
FROM events"""

CLUSTERS = """
SELECT vec_id, CAST(label AS BIGINT) cluster_id FROM embeddings"""

# Run-length masks: the one place where the dialects differ.
RUNS_DUCKDB = """
SELECT drawing_id, det_id mask_id, y, x1+y%3 x_start, x2-y%2 x_end
FROM (SELECT *, unnest(range(y1, y2)) y FROM dets_v) q"""

SAMPLES_DUCKDB = """
SELECT drawing_id, line_id, x1, y1, x2, y2, i,
  CAST(floor(x1+i*((x2-x1)/CAST(79 AS DOUBLE))) AS BIGINT) px,
  CAST(floor(y1+i*((y2-y1)/CAST(79 AS DOUBLE))) AS BIGINT) py,
  CASE WHEN (i+line_id)%(3+line_id%40)=0 THEN 0 ELSE 1 END hit
FROM (SELECT *, unnest(range(0, 80)) i FROM lines_v) q"""

_VIEWS = {
    "symbols_v": SYMBOLS, "dets_v": DETECTIONS.format(copies=COPIES_DUCKDB), "texts_v": TEXTS, "lines_v": LINES,
    "drawings_v": DRAWINGS, "edits_v": EDITS, "clusters_v": CLUSTERS,
    "runs_v": RUNS_DUCKDB, "samples_v": SAMPLES_DUCKDB,
}
_NEEDS = {"dets_v": ["symbols_v"], "drawings_v": ["symbols_v"], "runs_v": ["dets_v"],
          "samples_v": ["lines_v"]}


def oracle(body: str) -> str:
    """Puts the fixture views that the statement names in front of it."""
    wanted: list[str] = []

    def want(name: str) -> None:
        for other in _NEEDS.get(name, []):
            want(other)
        if name not in wanted:
            wanted.append(name)

    for name in _VIEWS:
        if name in body:
            want(name)
    ctes = [f"{name} AS ({_VIEWS[name].strip()})" for name in wanted]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes + [body[len("WITH RECURSIVE "):]])
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes + [body[len("WITH "):]])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


class Fixtures:
    """The drawing tables as DataFrames over one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _sql(self, statement: str, **tables: DataFrame) -> DataFrame:
        for name in tables:
            statement = statement.replace(f"FROM {name}", f"FROM {{{name}}}")
        return self.spark.sql(statement.replace('"text"', "text"), **tables)

    @property
    def symbols(self) -> DataFrame:
        return self._sql(SYMBOLS, part=self.table("part"))

    @property
    def detections(self) -> DataFrame:
        return self._sql(DETECTIONS.format(copies=COPIES_SPARK), symbols_v=self.symbols)

    @property
    def texts(self) -> DataFrame:
        return self._sql(TEXTS, customer=self.table("customer"))

    @property
    def lines(self) -> DataFrame:
        return self._sql(LINES, orders=self.table("orders"))

    @property
    def drawings(self) -> DataFrame:
        return self._sql(DRAWINGS, symbols_v=self.symbols)

    @property
    def edits(self) -> DataFrame:
        return self._sql(EDITS, events=self.table("events"))

    @property
    def clusters(self) -> DataFrame:
        return self._sql(CLUSTERS, embeddings=self.table("embeddings"))

    @property
    def embeddings(self) -> DataFrame:
        return self.table("embeddings")

    def _tasks(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    @property
    def runs(self) -> DataFrame:
        return self._runs(self.detections)

    @property
    def dealt_runs(self) -> DataFrame:
        """The same rows; boxes are dealt out by drawing first, as a file of few row groups is read by few tasks."""
        return self._runs(self.detections.repartition(self._tasks(), "drawing_id"))

    def _runs(self, detections: DataFrame) -> DataFrame:
        return detections.select(
            "drawing_id", F.col("det_id").alias("mask_id"),
            F.explode(F.expr("sequence(y1, y2-1)")).alias("y"), "x1", "x2",
        ).selectExpr("drawing_id", "mask_id", "y", "x1+y%3 x_start", "x2-y%2 x_end")

    @property
    def samples(self) -> DataFrame:
        return self.lines.select(
            "*", F.explode(F.expr("sequence(0L, 79L)")).alias("i"),
        ).selectExpr(
            "drawing_id", "line_id", "x1", "y1", "x2", "y2", "i",
            "CAST(floor(x1+i*((x2-x1)/79.0D)) AS BIGINT) px",
            "CAST(floor(y1+i*((y2-y1)/79.0D)) AS BIGINT) py",
            "CASE WHEN (i+line_id)%(3+line_id%40)=0 THEN 0 ELSE 1 END hit")

    @property
    def ink(self) -> DataFrame:
        """Ink as runs of a page: the pixels that the sampled lines hit."""
        return (self.samples.where("hit = 1").select("drawing_id", "px", "py").distinct()
                .selectExpr("drawing_id", "py y", "px x_start", "px+1 x_end"))

    @property
    def pixel_rows(self) -> DataFrame:
        """Grey values of every page, one array per row of pixels.

        The value at x is (13x + 7y + 5 drawing) % 256. Every row is a piece of
        one periodic sequence, as 13 * 197 = 1 (mod 256). Drawings are dealt out in a fixed
        number of parts first: their list is short, and Spark would make all pages in one task.
        """
        period = ",".join(str(13 * i % 256) for i in range(1600 + 256))
        starts = self.spark.range(256).selectExpr(
            "id start", f"slice(CAST(split('{period}', ',') AS ARRAY<SMALLINT>), CAST(id+1 AS INT), 1600) grey")
        pages = self.drawings.select("drawing_id").repartition(self._tasks())
        rows = pages.select("drawing_id", F.explode(F.expr("sequence(0L, 1099L)")).alias("y"))
        return (rows.withColumn("start", F.expr("(y*7+drawing_id*5)*197%256"))
                .join(F.broadcast(starts), "start").select("drawing_id", "y", "grey"))

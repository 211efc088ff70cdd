"""Work on drawings that a stage has not done yet, in batches or continuously."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

Stage = Callable[[DataFrame], DataFrame]


#: Parts of a manifest beyond which a run compacts it.
PARTS = 64


def _manifest(path: str) -> str:
    """Where finished drawings are noted; readers of the results skip this folder."""
    return f"{path.rstrip('/')}/_done"


def _folder(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def finished(spark: SparkSession, path: str, key_type: str = "bigint") -> DataFrame:
    """(drawing_id, run) of every finished drawing, with results or without. Of two runs that
    finished a drawing at the same time the first name counts."""
    target, system = _folder(spark, _manifest(path))
    if not system.exists(target):
        return spark.createDataFrame([], f"drawing_id {key_type}, run string")
    done = spark.read.schema(f"drawing_id {key_type}, run string").parquet(f"{_manifest(path)}/part=*")
    return done.groupBy("drawing_id").agg(F.min("run").alias("run"))


def todo(drawings: DataFrame, done: DataFrame) -> DataFrame:
    done = done.select(F.col("drawing_id").alias("_done"))
    return drawings.join(done, drawings["drawing_id"].eqNullSafe(F.col("_done")), "left_anti")


def results(spark: SparkSession, path: str, key_type: str = "bigint") -> DataFrame:
    """What the stage made, each finished drawing once, with its run. What a run wrote before it died
    without noting the drawings is not seen."""
    rows = spark.read.parquet(path.rstrip("/"))
    rows = rows.withColumn("run", F.col("run").cast("string"))
    done = finished(spark, path, key_type).withColumnsRenamed({"drawing_id": "_drawing", "run": "_run"})
    return rows.join(done, rows["drawing_id"].eqNullSafe(F.col("_drawing")) & (rows["run"] == F.col("_run")), "left_semi")


def run_missing(drawings: DataFrame, stage: Stage, path: str, run: str) -> DataFrame:
    """Runs the stage on the drawings that no other run has finished, and writes their results as one run.

    The manifest is the commit: results count from when their drawings are noted, which is one rename
    of the writer. A run that died before that left nothing that anyone reads, and one that is repeated
    under its name replaces what it wrote. Returns the drawings worked on.
    """
    spark = drawings.sparkSession
    key_type = drawings.schema["drawing_id"].dataType.simpleString()
    missing = todo(drawings, finished(spark, path, key_type).where(F.col("run") != run))
    stage(missing).write.mode("overwrite").parquet(f"{path}/run={run}")
    note(missing, path, run)
    return missing


def note(drawings: DataFrame, path: str, run: str) -> None:
    """Notes the drawings of a run as finished, and compacts the manifest when it has many parts."""
    spark = drawings.sparkSession
    key_type = drawings.schema["drawing_id"].dataType.simpleString()
    (drawings.select("drawing_id").distinct().withColumn("run", F.lit(run))
     .write.mode("overwrite").parquet(f"{_manifest(path)}/part={run}"))
    target, system = _folder(spark, _manifest(path))
    if len(system.listStatus(target)) > PARTS:
        compact(spark, path, key_type)


def compact(spark: SparkSession, path: str, key_type: str = "bigint") -> None:
    """Writes the manifest as one part and then deletes the parts it was made of. If that is cut short,
    entries are there twice and still count once."""
    target, system = _folder(spark, _manifest(path))
    parts = [status.getPath() for status in system.listStatus(target) if status.getPath().getName().startswith("part=")]
    whole = spark.read.schema(f"drawing_id {key_type}, run string").parquet(*(p.toString() for p in parts)).distinct()
    whole.write.parquet(f"{_manifest(path)}/part=all-{uuid.uuid4().hex}")
    for part in parts:
        system.delete(part, True)


def stream_documents(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New document files as they arrive, (drawing_id, value)."""
    return (spark.readStream.option("maxFilesPerTrigger", files_per_batch)
            .schema("value string, drawing_id bigint").text(path, wholetext=True)
            .select("drawing_id", "value"))


def follow(stream: DataFrame, stage: Stage, path: str, checkpoint: str) -> StreamingQuery:
    """Runs the stage on all documents there are and on those that came since last time.

    Every batch is a run of its own number, so one that is run again after a
    failure replaces its own results.
    """
    def batch(docs: DataFrame, number: int) -> None:
        run_missing(docs, stage, path, f"b{number}")

    return (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())

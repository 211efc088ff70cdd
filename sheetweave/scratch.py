"""Written tables that cut the lineage of iterative jobs.

Intermediate results go to Parquet below ``spark.checkpoint.dir``, so a lost
executor costs a re-read and not a re-run of all former rounds.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _LOCAL_ROOTS.setdefault(
        context.applicationId, tempfile.mkdtemp(prefix="sheetweave-")
    )


class Scratch:
    """Writes tables for one job and deletes those it no longer needs."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/sheetweave/{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(stored)] = path
        return stored

    def forget(self, stored: DataFrame) -> None:
        """Deletes a table of a former round, once its successor is written."""
        path = self._paths.pop(id(stored), None)
        if path is None:
            return
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        target.getFileSystem(conf).delete(target, True)

"""Written intermediate tables, and joins of a small table to the documents.

Tables go below ``spark.checkpoint.dir``, so a lost executor costs a re-read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sheetweave.scratch import Scratch

#: Bytes on disk up to which a written table is broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


class Store(Scratch):
    """Scratch tables whose size on disk is known."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark)
        self._names: dict[int, str] = {}

    def bytes_of(self, stored: DataFrame) -> int:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._paths[id(stored)])
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return path.getFileSystem(conf).getContentSummary(path).getLength()

    def bucketed(self, df: DataFrame, key: str, deal: bool = False) -> DataFrame:
        """Writes a table bucketed and sorted by ``key``: later joins by it move only the
        other side. ``df`` comes from an aggregation by the key, whose partitions are the
        buckets already, so each bucket is written by one task; otherwise ``deal`` deals it out so."""
        name, buckets = f"sheetweave_{uuid.uuid4().hex}", partitions(self.spark)
        if deal:
            df = df.repartition(buckets, key)
        (df.write.format("parquet").bucketBy(buckets, key).sortBy(key)
         .option("path", f"{self.base}/{name}").saveAsTable(name))
        stored = self.spark.table(name)
        self._paths[id(stored)] = f"{self.base}/{name}"
        self._names[id(stored)] = name
        return stored

    def plain(self, stored: DataFrame) -> DataFrame:
        """The files of a bucketed table without its buckets. For unions: Spark 4.1 takes a union of bucketed
        tables for dealt out by the key, but does not read it so, and leaves out the shuffle that follows."""
        return self.spark.read.schema(stored.schema).parquet(self._paths[id(stored)])

    def drop(self, *tables: DataFrame) -> None:
        """Deletes bucketed tables that nothing reads any more, files and entries of the catalogue."""
        for stored in tables:
            name = self._names.pop(id(stored), None)
            if name:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                self.forget(stored)

    def attach(self, large: DataFrame, stored: DataFrame, on, how: str = "inner",
               limit: int = BROADCAST_BYTES) -> DataFrame:
        """Joins a written table to a larger one: by broadcast if it is small, else by a
        shuffle join, which AQE splits at hot keys. Both ways give the same rows."""
        small = self.bytes_of(stored) <= limit
        return large.join(F.broadcast(stored) if small else stored, on, how)


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns that operators on texts read, under names of their own; null texts
    become empty. Other columns, whatever their names, stay behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

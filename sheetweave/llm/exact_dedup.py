"""Exact deduplication against a persistent digest index.

The index holds one row per distinct text: its SHA-256, the row that stays and the
number of rows seen when it came in. It is a Parquet table bucketed and sorted by the
digest, so the anti-join of a new batch reads it without shuffling or sorting it.
A batch is reduced to one row per digest before anything is shuffled; a text that a
third of all rows share costs one row per task. A digest stands for its text.

Defined results: null text counts as empty text, and empty texts are equal to each
other. Rows that repeat an id and a text share the verdict. A null id never wins over
another; a group of null ids only has ``keep_id`` null and keeps its rows. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sheetweave.llm.store import Store, id_text, partitions
from sheetweave.scratch import scratch_root

SCHEMA = "digest binary, keep_id long, seen long"


def digest(text) -> F.Column:
    """Lower-case hex SHA-256 of a text in UTF-8."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


def grouped(rows: DataFrame) -> DataFrame:
    """One row for each digest of a batch: the largest id and the number of rows."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("seen"))


class DigestIndex:
    """Digests of all texts taken so far, in a table with runs appended batch by batch.

    Texts of earlier batches win over those of later ones; within a batch the largest
    id wins. The location is given by the caller, or new below the scratch root. A location that
    has an index is opened again, by whatever session: the number of buckets is part of its
    folder's name, and the files say to which bucket they belong.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, name: str | None = None,
                 buckets: int | None = None):
        self.spark = spark
        self.path = path or f"{scratch_root(spark)}/sheetweave/digests-{uuid.uuid4().hex}"
        self.name = name or f"digests_{uuid.uuid4().hex}"
        found = self._folders()
        self.buckets = int(found[0].rsplit("-", 1)[1]) if found else buckets or partitions(spark)
        if found and not self.exists():
            fields = ", ".join(SCHEMA.split(", "))
            spark.sql(f"CREATE TABLE {self.name} ({fields}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
                      f"INTO {self.buckets} BUCKETS LOCATION '{self.folder}'")

    @property
    def folder(self) -> str:
        return f"{self.path}/digests-of-{self.buckets}"

    def _folders(self) -> list[str]:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        system = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in system.listStatus(target)] if system.exists(target) else []
        return [n for n in names if n.startswith("digests-of-")]

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name) if self.exists() else self.spark.createDataFrame([], SCHEMA)

    def add(self, batch: DataFrame) -> None:
        """Appends the digests of ``batch`` (doc_id, digest) that the index lacks."""
        new = grouped(batch)
        if self.exists():
            new = new.hint("merge").join(self.read().select("digest"), "digest", "left_anti")
        (new.repartition(self.buckets, "digest").write.mode("append").format("parquet")
         .bucketBy(self.buckets, "digest").sortBy("digest")
         .option("path", self.folder).saveAsTable(self.name))

    def drop(self) -> None:
        """Takes the index out of this session's catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def batches(rows: DataFrame, parts: int) -> list[DataFrame]:
    """Splits rows into about equal ranges of ids, the largest ids first; null ids come last."""
    cuts = rows.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 1000)).first()[0] if parts > 1 else None
    cuts = sorted(set(cuts or []))
    number = sum((F.coalesce((F.col("doc_id") > F.lit(c)).cast("int"), F.lit(0)) for c in cuts), F.lit(0))
    return [rows.where(number == k) for k in range(len(cuts), -1, -1)]


def exact_dedup(spark: SparkSession, docs: DataFrame, parts: int = 2) -> DataFrame:
    """Verdict for each row: doc_id, keep_id, group_size, kept, text_sha256.

    The rows come in ``parts`` batches of falling ids, so the row that the index keeps is
    the one with the largest id. Rows of texts that occur once are recognised without a
    join of hot groups: AQE splits those.
    """
    store = Store(spark)
    rows = store.save(id_text(docs).select("doc_id", F.unhex(digest(F.col("text"))).alias("digest")))
    index = DigestIndex(spark)
    for batch in batches(rows, parts):
        index.add(batch)
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    winners = store.save(index.read().join(sizes, "digest").select("digest", "keep_id", "group_size"))
    index.drop()
    return rows.join(winners, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def keep_distinct(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Each row has its own verdict:
    rows that share an id, or have none, and differ in text do not share it."""
    gone = exact_dedup(spark, docs).where(~F.col("kept"))
    return kept_rows(spark, docs, gone.select("doc_id", F.unhex("text_sha256").alias("digest")))


def kept_rows(spark: SparkSession, docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id and text are in ``dropped`` (doc_id, digest). Only
    these two are written and joined."""
    store = Store(spark)
    gone = store.save(dropped.select(F.col("doc_id").alias("_gone"), F.col("digest").alias("_digest")).distinct())
    own = F.unhex(digest(F.coalesce(docs["text"], F.lit(""))))
    return store.attach(docs, gone, docs["doc_id"].eqNullSafe(gone["_gone"]) & (own == gone["_digest"]), "left_anti")


def kept_ids(spark: SparkSession, docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is in ``dropped``, for verdicts that rows of an id share."""
    store = Store(spark)
    gone = store.save(dropped.select(F.col("doc_id").alias("_gone")).distinct())
    return store.attach(docs, gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(spark, spark.read.parquet(f"{folder}/documents.parquet"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

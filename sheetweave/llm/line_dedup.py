"""Removal of lines that many documents repeat, with levelled sorted runs of line hashes.

A run is a Parquet table bucketed and sorted by line hash. A batch is reduced to one row per line
hash and merge-anti-joined with the runs, which are not moved for that. What is left is new: it goes
into the batch's run with its largest id. Lines that the runs know add a count and no id. Batches
come by falling ids, so the id that a line came with first is the largest of all. When a level has
``fanout`` runs, they are merged into one run of the next level; at the end all runs are merged
into the top one, from which the common lines are read. Counting happens before the shuffle, so a line found
everywhere costs one row per task.

Defined results: null and empty text are one empty line. Keys shorter than
``min_chars`` code points are never dropped. Repeated rows of one id count as one
document; rows of null ids count as one document with the smallest id, and lose every
line that is dropped elsewhere. A line hash is the first 16 bytes of SHA-256.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from sheetweave.llm.exact_dedup import batches, digest
from sheetweave.llm.store import Store, id_text
from sheetweave.llm.texts import map_rows

#: Runs of a level that are merged into one, and bytes of line hashes of a batch.
FANOUT, BATCH_BYTES = 4, 64 << 30
_LOWER = {c: c + 32 for c in range(65, 91)}
#: White space that a key loses at both ends; fixed by the contract.
STRIP = " \t\n\x0b\x0c\r"


def line_key(line) -> F.Column:
    """Stripped at both ends, A-Z lower-cased, all else unchanged. ASCII lines take the
    faster function; it would change letters of other scripts too."""
    stripped = F.btrim(line, F.lit(STRIP))
    return F.when(F.octet_length(stripped) == F.char_length(stripped), F.lower(stripped)).otherwise(
        F.translate(stripped, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def line_hash(key, min_chars: int) -> F.Column:
    """Hash of a key that is long enough, else null."""
    return F.when(F.char_length(key) >= min_chars, F.substring(F.unhex(F.sha2(key, 256)), 1, 16))


class LineRuns:
    """Levelled runs of (h, n_docs, last_id, fresh). ``fresh`` rows are those of the batch that a line came
    with first; a line has one, and only that has an id."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.store = spark, fanout, Store(spark)
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> None:
        """Takes a batch of (doc_id, h), one row or more per document and line. No document may come in two
        batches, and no larger id after a smaller one."""
        counted = (lines.distinct().groupBy("h")
                   .agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_id")))
        if self.runs():
            counted = self.store.bucketed(counted, "h")
            new = counted
            for run in self.runs():
                new = new.hint("merge").join(run.where("fresh").select("h"), "h", "left_anti")
            new = self.store.bucketed(new, "h")
            known = counted.hint("merge").join(new.select("h"), "h", "left_anti")
            run = new.withColumn("fresh", F.lit(True)).unionByName(known.select(
                "h", "n_docs", F.lit(None).cast("long").alias("last_id"), F.lit(False).alias("fresh")))
            self.levels[0].append(self.store.bucketed(run, "h", deal=True))
            self.store.drop(new, counted)
        else:
            self.levels[0].append(self.store.bucketed(counted.withColumn("fresh", F.lit(True)), "h"))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merges the runs of a level into one of the next."""
        if level + 1 == len(self.levels):
            self.levels.append([])
        old, self.levels[level] = self.levels[level], []
        merged = reduce(DataFrame.unionByName, map(self.store.plain, old)).groupBy("h").agg(
            F.sum("n_docs").alias("n_docs"), F.max("last_id").alias("last_id"), F.max("fresh").alias("fresh"))
        self.levels[level + 1].append(self.store.bucketed(merged, "h"))
        self.store.drop(*old)

    def top(self) -> DataFrame:
        """One run of all lines: what the levels hold is merged upwards."""
        for level in range(len(self.levels)):
            if level + 1 < len(self.levels) and self.levels[level]:
                self.levels[level + 1] += self.levels[level]
                self.levels[level] = []
        if len(self.levels[-1]) > 1:
            self.compact(len(self.levels) - 1)
        return self.levels[-1][0]

    def end(self) -> None:
        self.store.drop(*self.runs())


def without(text: str, drops: list[bytes] | None, min_chars: int) -> tuple[int, int, str]:
    """Number of lines, of those dropped, and the text that is left."""
    lines = text.split("\n")
    if not drops:
        return len(lines), 0, text
    gone = set(drops)

    def stays(line: str) -> bool:
        key = line.strip(STRIP)
        if len(key) < min_chars:
            return True
        key = key.lower() if key.isascii() else key.translate(_LOWER)
        return hashlib.sha256(key.encode()).digest()[:16] not in gone

    kept = [line for line in lines if stays(line)]
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def line_dedup(spark: SparkSession, docs: DataFrame, min_chars: int = 20, min_docs: int = 3,
               parts: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for each row of ``docs``. There are ``parts`` batches, one more
    than the fan-out unless given, and more for tables of many lines."""
    texts = id_text(docs)
    store = Store(spark)
    lines = store.save(
        texts.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
        .select("doc_id", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)  # not by the hash, which a filter would work out twice
        .select("doc_id", line_hash(F.col("key"), min_chars).alias("h")).distinct())
    runs = LineRuns(spark)
    for batch in batches(lines, parts or max(FANOUT + 1, store.bytes_of(lines) // BATCH_BYTES)):
        runs.add(batch)
    common = store.save(runs.top().where(F.col("n_docs") >= min_docs).select("h", "last_id"))
    runs.end()
    drops = store.save(
        store.attach(lines, common, "h").where(~F.col("doc_id").eqNullSafe(F.col("last_id")))
        .groupBy("doc_id").agg(F.collect_list("h").alias("drops")).withColumnRenamed("doc_id", "_id"))
    joined = store.attach(texts, drops, texts["doc_id"].eqNullSafe(drops["_id"]), "left").select("doc_id", "text", "drops")

    def work(rows):
        for doc_id, text, dropped in rows:
            yield doc_id, *without(text, dropped, min_chars)

    return map_rows(joined, work, "doc_id long, n_lines long, n_dropped long, kept_text string")


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup(spark, spark.read.parquet(f"{folder}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", digest(F.col("kept_text")).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
    SELECT key, max(doc_id) AS last_id FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
    SELECT k.doc_id, k.line, k.pos, c.key IS NOT NULL AND k.doc_id <> c.last_id AS gone
    FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

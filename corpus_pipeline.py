"""A corpus of documents made ready for training, stage by stage.

Each stage takes all that the one before kept and returns the columns of ``documents``, the
last one token ids. ``run`` writes each result as Parquet and reads it again. SQL cannot
express language identification and BPE, so the tests compare the stages with plain
versions of their rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sheetweave.llm import bpe, decontamination, exact_dedup, jaccard, language_id
from sheetweave.llm.store import Store


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return language_id.keep_identified(spark, docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.keep_distinct(spark, docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id."""
    return jaccard.keep_representatives(spark, docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontamination.keep_clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids, and the digest of the decoded text."""
    found = bpe.bpe(docs, bpe.tokenizer_path())
    return found.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), "ids",
                        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identified),
    ("exact_dedup", distinct),
    ("ngram_jaccard", dissimilar),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if number + 1 == len(STAGES):
            return result
        before, docs = docs, store.save(result)
        if number:
            store.forget(before)

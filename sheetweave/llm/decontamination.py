"""Benchmark decontamination by canonical templates, in DataFrame functions only.

Numbers, names (capitalised words inside a sentence) and units after numbers become typed
placeholders; all else is lower-cased and stripped of marks. Windows of ``WINDOW`` template
words of the benchmark are hash-joined with those of the documents, so a question asked
again with other numbers or names still meets its item. Windows of the lower-cased words
themselves are joined beside them, so a verbatim passage meets its item whatever its case or
wrapping. Of the windows on one diagonal (the same shift between item and document) that match
by placeholder only, the placeholders are compared: each value of the item must stand for one
value throughout, else these windows do not count. Verbatim windows always count. A document
is contaminated by an item if the windows that count on a diagonal are ``SHARE`` of the item's
windows, or as many as ``RUN`` words in a row have. Windows with fewer than ``LITERALS``
literal words match verbatim only; both limits are tested with them and without them.

The benchmark's windows are broadcast if their table is small (see store.py), else both
sides are shuffled by the window's hash. Matches by hash are checked word by word.

Defined results: null texts and texts without words match nothing. A text or item shorter than a
window is one window as a whole: a bare question or answer meets a document that is just that, and no
longer one. Every text of an item id is matched; they count as one item, of which the id is
reported. Each text without an item id is an item, with a null ``item_id`` if no other hits.
Rows that share an id share the verdict, and so
do rows of null ids. With an empty benchmark every document is clean. Other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sheetweave.llm.exact_dedup import kept_ids
from sheetweave.llm.store import Store, id_text

WINDOW, LITERALS, SHARE, RUN = 8, 5, 0.5, 13
NAME, NUMBER, UNIT = "zznamezz", "zznumberzz", "zzunitzz"
#: Units that are placeholders after a number; fixed values.
UNITS = ("kilometres kilometers metres meters centimetres centimeters miles feet inches km cm mm m "
         "kilograms grams tonnes pounds ounces kg mg g lb oz litres liters ml l hours minutes seconds "
         "days weeks months years dollars euros cents percent degrees")


def spaced(text: Column) -> Column:
    """Single blanks for all white space, numbers without inner marks, and a space between a
    number and its unit. The letters whose case changes their number are spelt out."""
    for letter, plain in (("\u0130", "I"), ("\u1e9e", "SS"), ("\u00df", "ss")):
        text = F.replace(text, F.lit(letter), F.lit(plain))
    single = F.regexp_replace(text, r"[\s\p{Z}\x{85}]++(?<! )|[\s\p{Z}\x{85}]{2,}+", " ")
    joined = F.regexp_replace(single, r"(?<=[0-9])[.,](?=[0-9])", "")
    return F.regexp_replace(joined, r"([0-9])(" + "|".join(UNITS.split()) + r")(?![\p{L}\p{N}])", "$1 $2")


def words_of(text: Column) -> Column:
    """Runs of letters and digits; a text without any is one empty word."""
    return F.split(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " ")


def templated(text: Column) -> Column:
    """The text of ``spaced`` with placeholders; each stands for one word of it."""
    named = F.regexp_replace(text, r"\p{Lu}(?<=[\p{Ll}\p{N},;:] \p{Lu})\p{Ll}+", NAME)
    counted = F.regexp_replace(named, r"[0-9]++(?![\p{L}\p{N}])", NUMBER)
    units = F.regexp_replace(counted, f"{NUMBER} (?:{'|'.join(UNITS.split())})(?![\\p{{L}}\\p{{N}}])",
                             f"{NUMBER} {UNIT}")
    return F.lower(units)


def both_words(frame: DataFrame, *columns: str) -> DataFrame:
    """``columns``, ``words`` of the template and ``raw`` lower-cased words of ``text``, place by place."""
    return (frame.select(*columns, spaced(F.col("text")).alias("text"))
            .select(*columns, words_of(templated(F.col("text"))).alias("words"),
                    words_of(F.lower(F.col("text"))).alias("raw")))


def windows(frame: DataFrame, key: str) -> DataFrame:
    """(key, words, raw, at) for each window; positions count from 1. A shorter text with words is
    one window, which only another text of as many words can equal."""
    # The guard is part of the sequence: a filter would work out the words a second time.
    starts = F.when(F.element_at("words", 1) != "",
                    F.sequence(F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(1))))
    return frame.select(key, "words", "raw", F.explode(starts).alias("at"))


def hashes() -> list[Column]:
    """Hashes of a window's template words and of its words as they are."""
    return [F.xxhash64(F.slice(name, F.col("at"), WINDOW)).alias(f"h_{name}") for name in ("words", "raw")]


def usable(words: Column) -> Column:
    """Whether a window has enough literal words to match by its template."""
    return F.size(F.filter(words, lambda w: ~is_slot(w))) >= LITERALS


def is_slot(word: Column) -> Column:
    return word.isin(NAME, NUMBER, UNIT)


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_id (the smallest), for each row of ``docs``."""
    store = Store(spark)
    texts = id_text(docs)
    items = store.save(
        both_words(benchmark.where(F.col("text").isNotNull())
                   .select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
                   .select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "item", "item_id"))
    spots = store.save(
        windows(items, "item")
        .select("item", F.col("at").alias("pos"), usable(F.slice("words", F.col("at"), WINDOW)).alias("used"),
                *hashes()))
    known = store.save(spots.select("item", "pos", F.explode(F.array_distinct(
        F.when(F.col("used"), F.array("h_words", "h_raw")).otherwise(F.array("h_raw")))).alias("h")))
    possible = spots.groupBy("item").agg(F.count("*").alias("possible"), F.count_if("used").alias("possible_used"))
    own = (windows(both_words(texts, "doc_id"), "doc_id").select("doc_id", "at", *hashes())
           .select("doc_id", "at", F.explode(F.array_distinct(F.array("h_words", "h_raw"))).alias("h")))
    hits = store.save(store.attach(own, known, "h").select("doc_id", "item", "at", "pos"))
    # Once more over the texts that have hits, now with the words behind the placeholders.
    by_doc = store.save(hits.groupBy(F.col("doc_id").alias("_id"))
                        .agg(F.collect_set(F.struct("item", "at", "pos")).alias("hits")))
    again = (both_words(store.attach(texts, by_doc, texts["doc_id"].eqNullSafe(by_doc["_id"])), "doc_id", "hits")
             .select("doc_id", "words", "raw", F.explode("hits").alias("hit"))
             .select("doc_id", "hit.*", F.slice("words", F.col("hit.at"), WINDOW).alias("d_words"),
                     F.slice("raw", F.col("hit.at"), WINDOW).alias("d_raw")))
    sides = (store.attach(again, items, "item")
             .withColumn("b_words", F.slice("words", F.col("pos"), WINDOW))
             .withColumn("b_raw", F.slice("raw", F.col("pos"), WINDOW))
             .withColumn("used", usable(F.col("b_words")))
             .withColumn("verbatim", F.col("b_raw") == F.col("d_raw"))
             .where(F.col("verbatim") | (F.col("used") & (F.col("b_words") == F.col("d_words")))))
    pairs = F.arrays_zip(F.col("b_words").alias("t"), F.col("b_raw").alias("b"), F.col("d_raw").alias("d"))
    line = ["doc_id", "item", "shift"]
    seen = store.save(sides.select(
        "doc_id", "item", "pos", (F.col("at") - F.col("pos")).alias("shift"), "used", "verbatim",
        F.when(~F.col("verbatim"), F.filter(pairs, lambda p: is_slot(p["t"]))).alias("slots")))
    torn = (seen.select(*line, F.explode("slots").alias("slot"))
            .groupBy(*line, F.col("slot.b").alias("b")).agg(F.min("slot.d").alias("low"), F.max("slot.d").alias("high"))
            .where("low <> high").select(*[F.col(c).alias(f"x_{c}") for c in line]).distinct())
    covered = (seen.groupBy(*line, "pos", "used").agg(F.max("verbatim").alias("verbatim"))
               .groupBy(*line).agg(F.count("*").alias("n"), F.count_if("used").alias("n_used"),
                                   F.count_if("verbatim").alias("v"),
                                   F.count_if(F.col("used") & F.col("verbatim")).alias("v_used"))
               .join(torn, (F.col("doc_id").eqNullSafe(F.col("x_doc_id"))) & (F.col("item") == F.col("x_item"))
                     & (F.col("shift") == F.col("x_shift")), "left")
               .select(*line, F.when(F.col("x_item").isNull(), F.col("n")).otherwise(F.col("v")).alias("n"),
                       F.when(F.col("x_item").isNull(), F.col("n_used")).otherwise(F.col("v_used")).alias("n_used")))
    enough = lambda n, of: (n > 0) & (n >= F.least(SHARE * of, F.lit(RUN - WINDOW + 1)))
    guilty = (covered.join(possible, "item")
              .where(enough(F.col("n_used"), F.col("possible_used")) | enough(F.col("n"), F.col("possible")))
              .join(items.select("item", "item_id"), "item")
              .groupBy(F.col("doc_id").alias("_id"))
              .agg((F.count_distinct("item_id") + F.count_distinct(F.when(F.col("item_id").isNull(), F.col("item"))))
                   .alias("n_items"), F.min("item_id").alias("item_id")))
    verdict = store.save(guilty)
    return store.attach(texts.select("doc_id"), verdict, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id")


def keep_clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that no benchmark item contaminates, with all their columns."""
    return kept_ids(spark, docs, contaminated(spark, docs, benchmark).where("contaminated"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(spark, spark.read.parquet(f"{folder}/documents.parquet"),
                        spark.read.parquet(f"{folder}/benchmark.parquet"))

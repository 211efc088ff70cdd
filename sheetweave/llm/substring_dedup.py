"""Removal of long word sequences that an earlier document has, by suffix automata.

A window is ``WINDOW`` consecutive words. Its anchor is the smallest hash of the runs of
``ANCHOR`` words in it, so equal windows have equal anchors. Anchors found in one text
only, and then windows found in one text only, are dropped by counts; what is left of a
text are passages that other texts share. A passage is cut into pieces of windows with
one anchor, and equal pieces are folded to one, with the smallest id that has it.

All pieces of one anchor form a reference shard. Its suffix automaton takes the pieces by
rising id; each piece is streamed through it first, for matching statistics: where the
match is a window long, the state of that window tells the smallest id that has it.
The automaton compares the words themselves. The reference is the whole corpus, which
has no size bound, so shards are not broadcast but travel by their anchor; a task holds
one at a time. Only distinct shared pieces are in a shard, so a passage that a third of
all documents hold is one piece. A shard with more than ``SHARD_PIECES`` distinct pieces
is judged window by window instead, so that no task holds it; the result is the same.

Copies of a text are folded before, by digest; the distinct texts are shuffled once, into a
table bucketed by it, and all later steps are joined to that table. Defined results: null and short texts
lose nothing; a copy of a text of at least WINDOW words loses all words; windows that
repeat within one document only are kept. Null ids come after all others. Rows that
repeat an id and a text share their result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from sheetweave.llm.exact_dedup import digest
from sheetweave.llm.store import Store, id_text
from sheetweave.llm.texts import map_rows, sequence_hashes, word_bytes, word_hashes

WINDOW, ANCHOR = 50, 8
LAST = (1 << 63) - 1
#: Distinct pieces up to which the shard of an anchor goes through an automaton in one task.
SHARD_PIECES = 20_000
JUDGED = "pid binary, offs array<int>, counts array<int>, lows array<long>"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n, held, step = len(values) - width + 1, values, 1
    if n <= 0:
        return values[:0]
    while 2 * step <= width:
        held = np.minimum(held[:len(held) - step], held[step:])
        step *= 2
    return np.minimum(held[:n], held[width - step:width - step + n])


def anchors_of(words: np.ndarray) -> np.ndarray:
    """The anchor of each window, by its first word."""
    return sliding_min(sequence_hashes(words, ANCHOR), WINDOW - ANCHOR + 1)


class SuffixAutomaton:
    """A suffix automaton of several sequences; a state knows the first id put in with it."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [0]

    def _state(self, moves: dict, link: int, length: int, owner: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(owner)
        return len(self.next) - 1

    def _split(self, at: int, word, target: int) -> int:
        """A copy of ``target`` for the sequences that end in ``at`` followed by ``word``."""
        twin = self._state(dict(self.next[target]), self.link[target], self.length[at] + 1, self.owner[target])
        self.link[target] = twin
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = twin
            at = self.link[at]
        return twin

    def add(self, sequence, owner: int) -> None:
        last = 0
        for word in sequence:
            known = self.next[last].get(word)
            if known is not None:
                last = known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
                continue
            new = self._state({}, 0, self.length[last] + 1, owner)
            at = last
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = new
                at = self.link[at]
            if at >= 0:
                target = self.next[at][word]
                self.link[new] = (target if self.length[target] == self.length[at] + 1
                                  else self._split(at, word, target))
            last = new

    def owners(self, sequence, window: int):
        """For each window of ``sequence``, the owner of its first copy inside, or None."""
        state, matched = 0, 0
        for k, word in enumerate(sequence):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            if matched >= window:
                while self.length[self.link[state]] >= window:
                    state = self.link[state]
                matched = window
            if k + 1 >= window:
                yield self.owner[state] if matched >= window else None


def judged_shard(rows):
    """Rows (anchor, pid, low, piece) sorted by anchor: for each piece the runs of windows
    (offset, length, smallest id that has them)."""
    for _, group in groupby(rows, key=lambda r: r[0]):
        shard = sorted(((low, pid, piece.split(b" ")) for _, pid, low, piece in group), key=lambda p: p[:2])
        automaton = SuffixAutomaton()
        for k, (low, pid, words) in enumerate(shard):
            first = [low if o is None else o for o in automaton.owners(words, WINDOW)]
            if k + 1 < len(shard):
                automaton.add(words, low)
            starts = [i for i in range(len(first)) if not i or first[i] != first[i - 1]]
            ends = [*starts[1:], len(first)]
            yield pid, starts, [b - a for a, b in zip(starts, ends)], [first[i] for i in starts]


def _single_windows(rows):
    for _, pid, low, piece in rows:
        words = piece.split(b" ")
        for at in range(len(words) - WINDOW + 1):
            yield pid, low, at, hashlib.sha256(b" ".join(words[at:at + WINDOW])).digest()


def by_window(store: Store, shards: DataFrame) -> DataFrame:
    """The same as ``judged_shard`` for shards of any size: their windows one by one, so that no
    task holds a shard. Equal windows meet in an aggregation by their digest."""
    single = store.save(map_rows(shards, _single_windows, "pid binary, low long, at int, wid binary"))
    first = store.save(single.groupBy("wid").agg(F.min("low").alias("lows")))
    return (store.attach(single.drop("low"), first, "wid").groupBy("pid")
            .agg(F.collect_list(F.struct("at", "lows")).alias("w"))
            .select("pid", F.col("w.at").alias("offs"), F.transform("w", lambda _: F.lit(1)).alias("counts"),
                    F.col("w.lows").alias("lows")))


def _profile(rows):
    for cid, text in rows:
        words = word_hashes(text.encode("utf-8"))
        yield cid, np.unique(anchors_of(words)).view(np.int64)


def _windows(rows):
    """Windows whose anchor is shared: positions and hashes."""
    for cid, text, shared in rows:
        words = word_hashes(text.encode("utf-8"))
        at = np.flatnonzero(np.isin(anchors_of(words), np.array(shared, np.int64).view(np.uint64)))
        if len(at):
            yield cid, at.astype(np.int32), sequence_hashes(words, WINDOW)[at].view(np.int64)


def _runs(rows):
    """Positions of a document as runs: first and last of each, in turn."""
    for cid, positions in rows:
        at = np.unique(np.array(positions, np.int32))
        cut = np.flatnonzero(np.diff(at) > 1)
        yield cid, np.stack((at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]), 1).ravel()


def _pieces(rows):
    """Passages cut where the anchor changes: (anchor, pid, cid, low, start, piece)."""
    for cid, low, text, runs in rows:
        data = text.encode("utf-8")
        anchor, words = anchors_of(word_hashes(data)).view(np.int64), data.split()
        for a, b in zip(runs[::2], runs[1::2]):
            part = anchor[a:b + 1]
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
            for s, e in zip(starts, [*starts[1:], len(part)]):
                piece = b" ".join(words[a + s:a + e + WINDOW - 1])
                yield int(part[s]), hashlib.sha256(piece).digest()[:16], cid, low, a + s, piece


def covered(spans) -> list[tuple[int, int]]:
    """Merged word ranges from runs of windows (first window, number of windows)."""
    out: list[list[int]] = []
    for start, count in sorted(spans):
        end = start + count + WINDOW - 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def _ranges(rows):
    for cid, starts, counts in rows:
        merged = covered(zip(starts, counts))
        yield cid, [a for a, _ in merged], [b for _, b in merged]


def text_classes(store: Store, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key), and a table with one row for each distinct text (key, low, cid,
    text) bucketed by key, so that texts are shuffled once. Copies fold before the shuffle."""
    texts = id_text(docs).withColumn("key", F.unhex(F.sha2("text", 256)))
    own = F.coalesce("doc_id", F.lit(LAST)).alias("low")
    classes = texts.select("key", own, "text").groupBy("key").agg(F.min("low").alias("low"), F.first("text").alias("text"))
    return texts.select("doc_id", "key"), store.bucketed(
        classes.select("key", "low", F.monotonically_increasing_id().alias("cid"), "text"), "key")


def lost_ranges(store: Store, classes: DataFrame) -> DataFrame:
    """(key, starts, ends) for each text that has a window of a text with a smaller id."""
    ids = classes.select("key", "low", "cid")

    def keyed(found: DataFrame) -> DataFrame:
        return found.join(ids.select("key", "cid"), "cid").drop("cid")

    profile = store.save(map_rows(classes.select("cid", "text"), _profile, "cid long, anchors array<long>"))
    anchors = profile.select("cid", F.explode("anchors").alias("anchor"))
    several = F.min("cid") < F.max("cid")
    common = store.save(anchors.groupBy("anchor").agg(several.alias("s")).where("s").select("anchor"))
    marked = keyed(anchors.join(common, "anchor").groupBy("cid").agg(F.collect_set("anchor").alias("shared")))
    found = store.save(map_rows(classes.join(marked, "key").select("cid", "text", "shared"), _windows,
                                "cid long, at array<int>, hash array<long>"))
    windows = found.select("cid", F.explode(F.arrays_zip("at", "hash")).alias("w")).select("cid", "w.at", "w.hash")
    twice = store.save(windows.groupBy("hash").agg(several.alias("s")).where("s").select("hash"))
    passages = keyed(map_rows(
        windows.join(twice, "hash").groupBy("cid").agg(F.collect_list("at").alias("at")),
        _runs, "cid long, runs array<int>"))
    pieces = store.save(map_rows(
        classes.join(passages, "key").select("cid", "low", "text", "runs"), _pieces,
        "anchor long, pid binary, cid long, low long, start int, piece binary"))
    for old in (profile, common, found, twice):
        store.forget(old)
    shards = store.save(pieces.groupBy("anchor", "pid").agg(F.min("low").alias("low"), F.first("piece").alias("piece"))
                        .select("anchor", "pid", "low", "piece"))
    large = store.save(shards.groupBy("anchor").agg(F.count("*").alias("n"))
                       .where(F.col("n") > SHARD_PIECES).select("anchor"))
    fitting = store.attach(shards, large, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    judged = store.save(map_rows(fitting, judged_shard, JUDGED).unionByName(
        by_window(store, store.attach(shards, large, "anchor", "left_semi"))))
    store.forget(shards)
    lost = (pieces.select("pid", "cid", "low", "start").join(judged, "pid")
            .select("cid", "low", "start", F.explode(F.arrays_zip("offs", "counts", "lows")).alias("w"))
            .where("w.lows < low").selectExpr("cid", "start + w.offs AS start", "w.counts AS count"))
    return store.save(keyed(map_rows(
        lost.groupBy("cid").agg(F.collect_list("start").alias("starts"), F.collect_list("count").alias("counts")),
        _ranges, "cid long, starts array<int>, ends array<int>")))


def _without(rows):
    for key, low, text, starts, ends in rows:
        words = word_bytes(text)
        keep, at = [], 0
        for a, b in zip(starts or [], ends or []):
            keep += words[at:a]
            at = b
        keep += words[at:]
        yield key, low, len(words), len(words) - len(keep), b" ".join(keep).decode("utf-8")


def substring_classes(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key), and for each distinct text (key, low, n_words, n_removed, kept_text)
    what its row with the smallest id keeps."""
    store = Store(spark)
    rows, classes = text_classes(store, docs)
    ranges = lost_ranges(store, classes)
    left = classes.join(ranges, "key", "left").select("key", "low", "text", "starts", "ends")
    return rows, map_rows(left, _without,
                          "key binary, low long, n_words long, n_removed long, kept_text string")


def of_rows(rows: DataFrame, classes: DataFrame, kept: str, nothing) -> DataFrame:
    """Results of distinct texts for all rows; a copy with a smaller id of its text loses all."""
    copy = (F.coalesce("doc_id", F.lit(LAST)) > F.col("low")) & (F.col("n_words") >= WINDOW)
    return rows.join(classes, "key").select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, nothing).otherwise(F.col(kept)).alias(kept))


def substring_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: the words left, joined by one space."""
    return of_rows(*substring_classes(spark, docs), "kept_text", F.lit(""))


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows, classes = substring_classes(spark, spark.read.parquet(f"{folder}/documents.parquet"))
    hashed = classes.select("key", "low", "n_words", "n_removed", digest(F.col("kept_text")).alias("kept_sha256"))
    return of_rows(rows, hashed, "kept_sha256", digest(F.lit("")))


ORACLE = """
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
win AS (
    SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
hashed AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM win),
first AS (SELECT h, min(doc_id) AS low FROM hashed GROUP BY h),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k
    FROM hashed JOIN first USING (h) WHERE low < doc_id),
lost AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(ks), 0) AS n_removed,
       sha256(array_to_string(
           CASE WHEN ks IS NULL THEN w
                ELSE list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(ks, k)), lambda k: w[k]) END,
           ' ')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)
"""

"""Token-id files, compressed by Re-Pair grammars, with random access.

Documents are dealt to tasks by ranges of their id and encoded in id order, each followed
by an end id. A task cuts its ids into shards of about ``SHARD`` ids, at documents. Each
shard is compressed by itself: again and again frequent pairs of neighbours are
replaced by nonterminals, until a round over all pairs that pay saves next to nothing. A round replaces
many pairs at once; none has a symbol that is the left of one and the right of another, so no two
occurrences overlap. Of a run of equal symbols every other pair is replaced.

File format: Parquet rows (part, shard, doc_ids, lengths, rules, expansions, width,
symbols). ``rules`` has two unsigned 32-bit symbols for each nonterminal, ``expansions`` how many
ids it stands for, ``symbols`` the compressed sequence in integers of ``width`` bytes, all
little-endian. Nonterminals are numbered from ``first`` on, so the ids must be below it.
``read_slice`` decodes any range of ids without expanding the rest.

Defined results: null and empty texts have the end id alone. Rows that repeat an id stand
side by side in the files and in the result. Null ids come first. An empty table gives
no shards. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sheetweave.llm.bpe import encoder, tokenizer_path
from sheetweave.llm.store import Store, id_text, partitions
from sheetweave.llm.texts import map_rows

#: Ids of a shard.
SHARD = 1 << 20
#: Occurrences from which a pair saves (4 bytes each) more than its rule costs (two symbols and a length).
LEAST = 4
#: Share of the sequence that a round has to save net of its rules, else it was the last.
WORTH = 0.01
#: Cells of the table of pairs that are looked up, beyond which they are searched.
TABLE = 1 << 23
#: Words that a worker keeps encoded, in each of two generations.
CACHED_WORDS = 400_000
FORMAT = ("part int, shard int, doc_ids array<long>, lengths array<int>, first long, rules binary, "
          "expansions binary, width int, symbols binary")


def chosen_pairs(sequence: np.ndarray, symbols: int, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Left and right symbols of pairs that pay and can be replaced together."""
    bits = 16 if symbols <= 1 << 16 else 32  # short codes are sorted four times as fast
    kind = np.uint32 if bits == 16 else np.uint64
    pairs = sequence[:-1].astype(kind) << kind(bits)
    pairs |= sequence[1:].astype(kind)
    pairs.sort()
    if not len(pairs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
    counts = np.diff(np.append(starts, len(pairs)))
    often = np.flatnonzero(counts >= LEAST)
    counts, codes = counts[often], pairs[starts[often]].astype(np.uint64)
    left, right = (codes >> np.uint64(bits)).astype(np.int64), (codes & np.uint64((1 << bits) - 1)).astype(np.int64)
    equal = left == right
    counts = np.where(equal, (counts + 1) // 2, counts)  # such pairs overlap each other
    # A symbol is used where it saves most in this round: as a left one, a right one, or with itself. Of two
    # about equal uses the turn decides, so symbols in a ring do not all want the same.
    weight = [np.bincount(side[use], counts[use], symbols) for side, use in ((left, ~equal), (right, ~equal), (left, equal))]
    drawn = (np.arange(symbols, dtype=np.uint32) * np.uint32(2654435761) + np.uint32(turn * 40503)) * np.uint32(2246822519)
    lean = 0.8 + 0.4 * (drawn >> np.uint32(16)) / 65536
    use = np.where(weight[2] > np.maximum(weight[0], weight[1]), 2, weight[0] < weight[1] * lean)
    taken = (counts >= LEAST) & np.where(equal, use[left] == 2, (use[left] == 0) & (use[right] == 1))
    if not taken.any() and (counts >= LEAST).any():
        taken[np.argmax(counts)] = True
    return left[taken], right[taken]


def matches(sequence: np.ndarray, left: np.ndarray, right: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs in a sequence, and which pair each is."""
    number, sides = {}, []
    for name, side in (("l", left), ("r", right)):
        number[name] = np.full(symbols, -1, np.int32)
        there = np.unique(side)
        number[name][there] = np.arange(len(there))
        sides.append(len(there))
    a, b = number["l"][sequence[:-1]], number["r"][sequence[1:]]
    at = np.flatnonzero((a >= 0) & (b >= 0))
    codes = a[at].astype(np.int64) * sides[1] + b[at]
    own = number["l"][left].astype(np.int64) * sides[1] + number["r"][right]
    if sides[0] * sides[1] <= TABLE:
        table = np.zeros(sides[0] * sides[1], np.int32)
        table[own] = np.arange(1, len(own) + 1)
        found = table[codes] - 1
    else:
        order = np.argsort(own)
        place = np.minimum(np.searchsorted(own[order], codes), len(own) - 1)
        found = np.where(own[order][place] == codes, order[place], -1)
    return at[found >= 0], found[found >= 0]


def compress(ids: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (k, 2), expansion lengths (k), and the compressed sequence."""
    present = np.zeros(first, np.bool_)
    present[ids] = True
    named = np.flatnonzero(present)  # symbols are numbered closely while pairs are replaced
    sequence = (np.cumsum(present, dtype=np.uint32) - np.uint32(1))[ids]
    rules, sizes = [], np.ones(len(named), np.int64)
    while len(sequence) >= 2 * LEAST:
        left, right = chosen_pairs(sequence, len(sizes), len(rules))
        if not len(left):
            break
        at, number = matches(sequence, left, right, len(sizes))
        # Only pairs of equal symbols follow each other: every other one of such a run is replaced.
        run = np.maximum.accumulate(np.where(np.append(True, at[1:] != at[:-1] + 1), np.arange(len(at)), 0))
        other = (np.arange(len(at)) - run) % 2 == 0
        at, number = at[other], number[other]
        if len(at) - 3 * len(left) < len(sequence) * WORTH:
            break
        sequence[at] = (len(sizes) + number).astype(np.uint32)
        keep = np.ones(len(sequence), bool)
        keep[at + 1] = False
        sequence = sequence[keep]
        rules.append(np.stack((left, right), 1))
        sizes = np.concatenate((sizes, sizes[left] + sizes[right]))
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    name = np.concatenate((named, first + np.arange(len(table)))).astype(np.uint32)
    return name[table], sizes[len(named):].astype(np.uint32), name[sequence]


class Shard:
    """A compressed shard as read from a file."""

    def __init__(self, first: int, rules: bytes, expansions: bytes, width: int, symbols: bytes):
        self.first = first
        self.rules = np.frombuffer(rules, "<u4").reshape(-1, 2)
        self.sizes = np.frombuffer(expansions, "<u4").astype(np.int64)
        self.symbols = np.frombuffer(symbols, f"<u{width}")
        self._ends = self._flat = None

    def _held(self, sequence: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        held = np.ones(len(sequence), np.int64)
        deep = sequence >= self.first
        held[deep] = self.sizes[sequence[deep].astype(np.int64) - self.first]
        return held

    def _expanded(self, sequence: np.ndarray) -> np.ndarray:
        """Ids of a run of symbols, copied from a table with the ids of every rule."""
        if self._flat is None:
            self._at = np.concatenate((np.arange(self.first), self.first + np.cumsum(self.sizes) - self.sizes))
            self._flat = np.arange(self.first + int(self.sizes.sum()), dtype=np.uint32)
            # Rules refer to earlier ones: those that refer to what is filled already are filled at once.
            latest = np.maximum.accumulate(self.rules.max(axis=1, initial=0).astype(np.int64))
            done = 0
            while done < len(self.rules):
                ready = int(np.searchsorted(latest, self.first + done, "left"))
                start = int(self._at[self.first + done])
                part = self._copied(self.rules[done:ready].ravel())
                self._flat[start:start + len(part)] = part
                done = ready
        return self._copied(sequence)

    def _copied(self, sequence: np.ndarray) -> np.ndarray:
        held = self._held(sequence)
        ends = np.cumsum(held)
        shift = self._at[sequence] - (ends - held)
        return self._flat[np.repeat(shift, held) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def ids(self) -> np.ndarray:
        return self._expanded(self.symbols)

    def read_slice(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` up to ``end``, expanding only the symbols that hold them."""
        if self._ends is None:
            self._ends = np.cumsum(self._held(self.symbols))
        if end <= start:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self._ends, start, "right"))
        b = int(np.searchsorted(self._ends, end, "left")) + 1
        before = int(self._ends[a - 1]) if a else 0
        return self._expanded(self.symbols[a:b])[start - before:end - before]


def shard_row(part: int, number: int, doc_ids: list, lengths: list, ids: np.ndarray, first: int) -> tuple:
    rules, sizes, symbols = compress(ids, first)
    width = 2 if first + len(rules) <= 1 << 16 else 4
    return (part, number, doc_ids, lengths, first, rules.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(),
            width, symbols.astype(f"<u{width}").tobytes())


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard: int = SHARD) -> None:
    """Encodes all rows and writes the shards below ``path``."""

    def work(rows) -> Iterator[tuple]:
        bpe = encoder(tokenizer, CACHED_WORDS)
        end = np.uint32(end_id).astype("<u4").tobytes()
        first, part, number = len(bpe.pieces), TaskContext.get().partitionId(), 0
        doc_ids, lengths, held, total = [], [], [], 0
        for doc_id, text in rows:
            ids = b"".join(map(bpe.words.__getitem__, text.encode("utf-8").split())) + end
            doc_ids.append(doc_id)
            lengths.append(len(ids) // 4)
            held.append(ids)
            total += lengths[-1]
            if total >= shard:
                yield shard_row(part, number, doc_ids, lengths, np.frombuffer(b"".join(held), "<u4"), first)
                doc_ids, lengths, held, total, number = [], [], [], 0, number + 1
        if doc_ids:
            yield shard_row(part, number, doc_ids, lengths, np.frombuffer(b"".join(held), "<u4"), first)

    texts = id_text(docs)
    ranged = texts.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    map_rows(ranged, work, FORMAT).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids: from the files alone."""
    shards = spark.read.schema(FORMAT).parquet(path)
    sizes = shards.select("part", "shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    # One row for each task that wrote: the only sums that are not split by part.
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inner = sizes.select("part", "shard", (
        F.sum("n").over(Window.partitionBy("part").orderBy("shard")) - F.col("n")).alias("inner"))
    store = Store(spark)
    starts = store.save(inner.join(before, "part").select(
        "part", "shard", (F.col("base") + F.col("inner")).alias("start")))
    placed = store.attach(shards, starts, ["part", "shard"]).select(
        "doc_ids", "lengths", "start", "first", "rules", "expansions", "width", "symbols")

    def work(rows):
        for doc_ids, lengths, start, first, rules, expansions, width, symbols in rows:
            ids, at = Shard(first, rules, expansions, width, symbols).ids(), 0
            for doc_id, length in zip(doc_ids, lengths):
                yield doc_id, start + at, ids[at:at + length].astype("<u4").tobytes()
                at += length

    return map_rows(placed, work, "doc_id long, start long, ids binary")


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = Store(spark).base + "-tokens"
    write_token_files(spark.read.parquet(f"{folder}/documents.parquet"), path, tokenizer_path(), end_id=2)
    return read_token_files(spark, path).select(
        "doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))

"""N-gram Jaccard join by universe partition and the pigeonhole principle.

A document is the set of hashes of its shingles. Two sets x, y with Jaccard similarity
of at least 0.8 differ in d tokens, 9 d <= |x| + |y|, so d <= |x| / 4 for either of them.

Signatures. Documents fall into bands by the binary logarithm of their size. In a band
the universe of tokens is dealt by hash to ``m`` segments, and a document emits a
signature for each of its first floor(|x|/4) + 1 + slack non-empty segments. Each
differing token touches one segment, so a linked pair has at least slack + 1 equal
segments that both emit. Documents large enough to have partners in the next lower band
emit signatures there too. Where it is cheaper by ``allocation`` (small sets), the band
has one segment, and all its one-deletion neighbours are emitted instead. A document
whose tokens fill too few segments also emits each of its tokens by itself; two such
documents meet there, and one such document meets a regular one in the segments.

Choice by frequency. Signatures of one document only are dropped. Each document then
drops its ``slack`` most frequent ones; as the order is the same for all, a linked pair
keeps at least one common signature. No document is left out of a frequent bucket.

Verification. In a bucket the document in most buckets is the leader. A group is a leader
with all documents that share a bucket with it, so it holds all pairs of these buckets.
Groups are dealt to tasks in pairs of blocks of bounded size, where an exact
intersection count of all sets gives the links, of which only a spanning forest leaves
the task. Pairs are never written.

Copies of a text are folded to one row before, by digest. Shingle hashes have 64 bits.

Defined results: texts without words have no shingles and no links; their component is
their own id. Repeated rows of a text are one class; null ids take the component of
their class, null if there is no other id. Other columns are not read.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sheetweave.llm.components import components
from sheetweave.llm.exact_dedup import kept_rows
from sheetweave.llm.store import Store, id_text
from sheetweave.llm.texts import map_rows, mix, sequence_hashes, word_hashes

WORDS = 5
#: Members and tokens of a block of a group; a task holds two blocks.
BLOCK_MEMBERS, BLOCK_TOKENS = 512, 1 << 19
#: Bits that hold the band in a signature; tokens of irregular documents use bands from 32 on.
BAND_SHIFT = 58
#: Weight of a document that meets others in a segment by chance, in rows.
CHANCE = 8.0


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle."""
    words = word_hashes(text.encode("utf-8"), lower=True)
    if not len(words):
        return words
    return np.unique(sequence_hashes(words, min(WORDS, len(words))) ^ np.uint64(len(words) if len(words) < WORDS else 0))


def slack(band: int) -> int:
    return (1 << band) // 32


def allocation(band: int) -> tuple[int, bool]:
    """Segments of a band, and whether one-deletion neighbours are emitted.

    One segment with its deletions covers a difference of one token. It is taken if the
    band allows no more, and its rows cost less than small equal segments do by chance
    meetings; else segments of about two tokens must be equal."""
    high = (2 << band) - 1
    segments = max(1, math.ceil(0.4 * high))
    difference = (high + high * 5 // 4) // 9
    if difference <= 1:
        equal = (difference + 1) * (1 + CHANCE * math.exp(-high / segments))
        if difference == 0 or high + 1 <= equal:
            return 1, difference == 1
    return segments, False


def signatures(tokens: np.ndarray) -> np.ndarray:
    """All signatures of a set, for its band and where needed the next lower one."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64)
    band = n.bit_length() - 1
    out = [_in_band(tokens, band)]
    if band and -(-4 * n // 5) < 1 << band:
        out.append(_in_band(tokens, band - 1))
    return np.concatenate(out).view(np.int64)


def _coded(values: np.ndarray, band: int) -> np.ndarray:
    return (mix(values) >> np.uint64(64 - BAND_SHIFT)) | np.uint64(band << BAND_SHIFT)


def _in_band(tokens: np.ndarray, band: int) -> np.ndarray:
    segments, deletions = allocation(band)
    n, spread = len(tokens), mix(tokens + np.uint64(band + 1))
    with np.errstate(over="ignore"):
        if segments == 1:
            whole = spread.sum(dtype=np.uint64)
            found = np.append(whole - spread, whole) if deletions and n > 1 else np.array([whole])
            return _coded(found, band)
        place = (spread >> np.uint64(33)) % np.uint64(segments)
        order = np.argsort(place, kind="stable")
        place = place[order]
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        sums = np.add.reduceat(spread[order], first)
        wanted = n // 4 + 1 + slack(band)
        found = sums[:wanted] * np.uint64(0xFF51AFD7ED558CCD) + place[first[:wanted]]
        if len(first) < wanted:
            return np.concatenate((_coded(found, band), _coded(tokens, band + 32)))
        return _coded(found, band)


def verified(rows):
    """Links within pairs of blocks: rows (leader, i, j, cid, block, set) sorted by the first
    three. Yields (a, b) links that span each set of linked documents."""
    for (_, i, j), group in groupby(rows, key=lambda r: r[:3]):
        members: dict[int, np.ndarray] = {}
        for row in group:
            members[row[3]] = np.frombuffer(row[5], np.uint64)
        ids, sets = list(members), list(members.values())
        if len(ids) > 1:
            for a, b in spanning(link_matrix(sets)):
                yield ids[a], ids[b]


def link_matrix(sets: list[np.ndarray]) -> np.ndarray:
    """True where 100 * intersection >= 80 * union."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        linked = 9 * common >= 4 * sizes.sum()
        return np.array([[True, linked], [linked, True]])
    code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = count[code] > 1
    code, owner = (np.cumsum(count > 1) - 1)[code[shared]], owner[shared]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, 2048):
        a, b = np.searchsorted(code, [start, start + 2048])
        held = np.unique(owner[a:b])
        block = np.zeros((len(held), 2048), np.float32)
        block[np.searchsorted(held, owner[a:b]), code[a:b] - start] = 1
        common[np.ix_(held, held)] += block @ block.T
    return 9 * common >= 4 * (sizes[:, None] + sizes[None, :])


def spanning(linked: np.ndarray):
    """A link from each node of a component to the one it was found from."""
    left = np.ones(len(linked), bool)
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front:
            node = front.pop()
            new = np.flatnonzero(linked[node] & left)
            left[new] = False
            for other in new.tolist():
                yield node, other
                front.append(other)


def jaccard_join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row."""
    return joined(spark, docs).drop("key")


def joined(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, key (the digest of the text), n_shingles, component_id for each row."""
    store = Store(spark)
    texts = id_text(docs).withColumn("key", F.unhex(F.sha2("text", 256)))
    classes = store.save(
        texts.groupBy("key").agg(F.min("doc_id").alias("low"))
        .select("key", "low", F.monotonically_increasing_id().alias("cid")))

    def emit(rows):
        for cid, text in rows:
            found = shingles(text)
            yield cid, len(found), signatures(found)

    # One row of each class reads its text; rows that repeat id and text are dropped later.
    first = store.attach(texts, classes, "key").where(F.col("doc_id").eqNullSafe(F.col("low"))).select("cid", "text")
    sets = store.save(map_rows(first, emit, "cid long, n long, sigs array<long>"))
    band = F.shiftrightunsigned("sig", BAND_SHIFT).cast("int")
    shared = store.save(
        sets.select(F.explode("sigs").alias("sig"), "cid")
        .withColumn("f", F.count("*").over(Window.partitionBy("sig"))).where("f > 1").distinct())
    drop = F.expr(f"CASE WHEN shiftrightunsigned(sig, {BAND_SHIFT}) < 32 THEN "
                  f"shiftleft(1, CAST(shiftrightunsigned(sig, {BAND_SHIFT}) AS INT)) div 32 ELSE 0 END")
    by_doc = Window.partitionBy("cid")
    in_band = Window.partitionBy("cid", "band").orderBy(F.desc("f"), "sig")
    kept = store.save(
        shared.withColumn("band", band).withColumn("pop", F.sum("f").over(by_doc))
        .withColumn("place", F.row_number().over(in_band)).where(F.col("place") > drop)
        .select("sig", "cid", "pop", "band"))
    leaders = kept.groupBy("sig").agg(F.max(F.struct("pop", "cid")).alias("top"), F.count("*").alias("k"))
    pairs = store.save(
        kept.join(leaders.where("k > 1").select("sig", F.col("top.cid").alias("leader")), "sig")
        .groupBy("leader", "cid").agg(F.max(F.pmod("band", F.lit(32))).alias("band")))
    blocks = store.save(
        pairs.groupBy("leader")
        .agg(F.count("*").alias("g"), F.sum(F.expr("shiftleft(2L, band)")).alias("tokens")).where("g > 1")
        .selectExpr("leader", f"greatest(ceil(g / {BLOCK_MEMBERS}), ceil(tokens / {BLOCK_TOKENS})) nb"))
    wanted = store.save(
        store.attach(pairs, blocks, "leader").groupBy("cid")
        .agg(F.collect_list(F.struct("leader", "nb")).alias("groups"))
        .join(classes, "cid").select("key", "low", "cid", "groups"))

    def deal(rows):
        for cid, text, groups in rows:
            found = shingles(text).tobytes()
            place = int(mix(np.array([cid], np.uint64))[0] >> np.uint64(33))
            for group in groups:
                own = place % group["nb"]
                for other in range(group["nb"]):
                    yield group["leader"], min(own, other), max(own, other), cid, own, found

    members = store.attach(texts, wanted, "key").where(
        F.col("doc_id").eqNullSafe(F.col("low"))).select("cid", "text", "groups")
    dealt = map_rows(members, deal, "leader long, i long, j long, cid long, block long, tokens binary")
    links = map_rows(dealt.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j"),
                     verified, "a long, b long")
    found = components(store, links)
    named = (found.join(classes, found["node"] == classes["cid"])
             .select("node", "component", "low"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    linked = named.join(lowest, "component").select(F.col("node").alias("cid"), "component_id")
    result = store.save(
        classes.join(sets.select("cid", "n").distinct(), "cid").join(linked, "cid", "left")
        .select("key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "low").alias("component_id")))
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return store.attach(texts.select("doc_id", "key"), result, "key").select(
        "doc_id", "key", "n_shingles", alone.alias("component_id"))


def keep_representatives(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows whose id is the smallest of their component, with all their columns. Rows that
    share an id, or have none, and differ in text have verdicts of their own."""
    gone = joined(spark, docs).where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    return kept_rows(spark, docs, gone.select("doc_id", F.col("key").alias("digest")))


def op6_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join(spark, spark.read.parquet(f"{folder}/documents.parquet"))


ORACLE = """
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id),
l AS (
    SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
    WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id
FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""

"""Exact, line and substring dedup, and the Jaccard join, against plain versions."""

import random

import numpy as np
import pytest

from sheetweave.llm import exact_dedup, jaccard, line_dedup, store, substring_dedup
from tests.llm import plain


def got(df, *columns):
    return sorted((tuple(row[c] for c in columns) for row in df.collect()), key=repr)


def test_exact(spark, make_docs, corpus):
    rows = corpus + [corpus[0], (None, "one"), (None, None)]
    for parts in (1, 3):
        found = exact_dedup.exact_dedup(spark, make_docs(rows), parts)
        assert got(found, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(plain.exact(rows), key=repr)


def test_exact_keeps_columns(spark, make_docs):
    docs = make_docs([(1, "a"), (2, "a"), (3, None), (None, None), (4, "b")])
    kept = exact_dedup.keep_distinct(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]


def test_index_takes_batches(spark):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    rows = lambda *x: spark.createDataFrame([(d, bytes([k])) for d, k in x], "doc_id long, digest binary")
    index.add(rows((1, 1), (2, 1), (3, 2)))
    index.add(rows((9, 1), (5, 3)))
    index.add(rows((7, 3)))
    assert sorted((r["digest"][0], r["keep_id"], r["seen"]) for r in index.read().collect()) == [
        (1, 2, 2), (2, 3, 1), (3, 5, 1)]
    index.drop()
    # Another session that knows the path alone goes on where this one stopped.
    again = exact_dedup.DigestIndex(spark, index.path)
    assert again.name != index.name and again.buckets == 3
    again.add(rows((99, 3), (98, 4)))
    assert sorted((r["digest"][0], r["keep_id"], r["seen"]) for r in again.read().collect()) == [
        (1, 2, 2), (2, 3, 1), (3, 5, 1), (4, 98, 1)]
    again.drop()


def test_lines(spark, make_docs, corpus):
    found = line_dedup.line_dedup(spark, make_docs(corpus), parts=3)
    assert got(found, "doc_id", "n_lines", "n_dropped", "kept_text") == sorted(plain.lines(corpus), key=repr)


def test_line_runs_compact(spark):
    """Every line is new once, in the batch with its largest id; merged runs say the same as all batches."""
    runs = line_dedup.LineRuns(spark, fanout=2)
    for start in range(4, -1, -1):
        runs.add(spark.createDataFrame([(10 * start + k, bytes([k % (6 - start)])) for k in range(6)], "doc_id long, h binary"))
        fresh = [bytes(r["h"]) for run in runs.runs() for r in run.where("fresh").collect()]
        assert sorted(fresh) == [bytes([k]) for k in range(6 - start)]
        assert all(r["last_id"] is None for run in runs.runs() for r in run.where("NOT fresh").collect())
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    ids = {k: [10 * s + j for s in range(5) for j in range(6) if j % (6 - s) == k] for k in range(6)}
    assert sorted((r["h"][0], r["n_docs"], r["last_id"]) for r in runs.top().collect()) == [
        (k, len(v), max(v)) for k, v in ids.items()]
    before = {t.name for t in spark.catalog.listTables()}
    runs.end()
    assert len(before - {t.name for t in spark.catalog.listTables()}) == 1


def test_ids_from_end_to_end_of_a_long(spark, make_docs):
    line = "a line of more than twenty letters"
    rows = [(6 * 10**18, line), (-6 * 10**18, line), (0, f"{line}\nx"), (None, line), (1, "y"), (2, "y")]
    found = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(spark, make_docs(rows)).collect()}
    assert found == {6 * 10**18: 0, -6 * 10**18: 1, 0: 1, None: 1, 1: 0, 2: 0}
    kept = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(spark, make_docs(rows), 4).collect()}
    assert kept == {6 * 10**18: 6 * 10**18, -6 * 10**18: 6 * 10**18, 0: 0, None: 6 * 10**18, 1: 2, 2: 2}


def test_long_documents_of_common_lines(spark, make_docs):
    """A document of 60,000 lines that all are common elsewhere is done in one pass over them."""
    lines = [f"the common line with number {k}" for k in range(60_000)]
    rows = [(k, "\n".join(lines)) for k in range(3)]
    found = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(spark, make_docs(rows)).collect()}
    assert found == {0: 60_000, 1: 60_000, 2: 0}


def test_substrings(spark, make_docs, corpus):
    found = substring_dedup.substring_dedup(spark, make_docs(corpus))
    assert got(found, "doc_id", "n_words", "n_removed", "kept_text") == sorted(plain.substrings(corpus), key=repr)


def test_substrings_of_a_small_alphabet(spark, make_docs):
    """Windows that overlap themselves and share parts in many ways."""
    chance = random.Random(3)
    rows = [(k, " ".join(chance.choice("ab") * chance.randint(1, 2) if chance.random() < 0.1 else "a"
                         for _ in range(chance.randint(40, 120)))) for k in range(40)]
    found = substring_dedup.substring_dedup(spark, make_docs(rows))
    assert got(found, "doc_id", "n_words", "n_removed", "kept_text") == sorted(plain.substrings(rows), key=repr)


def test_large_shards_go_by_window(spark, make_docs, corpus, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_PIECES", 1)
    found = substring_dedup.substring_dedup(spark, make_docs(corpus))
    assert got(found, "doc_id", "n_words", "n_removed", "kept_text") == sorted(plain.substrings(corpus), key=repr)


def test_automaton():
    chance = random.Random(8)
    for _ in range(200):
        pieces = [[chance.choice("abc") for _ in range(chance.randint(1, 14))] for _ in range(5)]
        automaton, first = substring_dedup.SuffixAutomaton(), {}
        for owner, piece in enumerate(pieces):
            window = 3
            expected = [first.get(tuple(piece[i:i + window])) for i in range(len(piece) - window + 1)]
            assert list(automaton.owners(piece, window)) == expected
            automaton.add(piece, owner)
            for i in range(len(piece) - window + 1):
                first.setdefault(tuple(piece[i:i + window]), owner)


def test_jaccard(spark, make_docs, corpus):
    rows = corpus + [corpus[3]]
    found = jaccard.jaccard_join(spark, make_docs(rows))
    assert got(found, "doc_id", "n_shingles", "component_id") == sorted(plain.similar(rows), key=repr)


def test_jaccard_in_small_blocks(spark, make_docs, corpus, monkeypatch):
    """A group of near copies dealt over many pairs of blocks, and joins without broadcast."""
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 4)
    monkeypatch.setattr(store.Store, "attach", lambda self, large, stored, on, how="inner", limit=0: large.join(stored, on, how))
    found = jaccard.jaccard_join(spark, make_docs(corpus))
    assert got(found, "doc_id", "n_shingles", "component_id") == sorted(plain.similar(corpus), key=repr)


def test_signatures_meet():
    """Every pair of sets within the limit keeps a common signature after the choice by frequency."""
    chance = np.random.default_rng(4)
    for n in [1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 15, 16, 17, 30, 31, 32, 40, 63, 64, 80, 127, 129, 300]:
        for _ in range(60):
            x = chance.integers(0, 2**63, n).astype(np.uint64)
            out = int(chance.integers(0, n // 5 + 1))
            new = int(chance.integers(0, (n - 9 * out // 8) // 4 + 2))
            y = np.concatenate((x[out:], chance.integers(0, 2**63, new).astype(np.uint64)))
            if 9 * (out + new) > len(x) + len(y):
                continue
            a, b = jaccard.signatures(np.sort(x)), jaccard.signatures(np.sort(y))
            common = set(a.tolist()) & set(b.tolist())
            bands = [int(np.uint64(s & (2**64 - 1)) >> np.uint64(jaccard.BAND_SHIFT)) for s in common]
            assert any(bands.count(k) > (jaccard.slack(k) if k < 32 else 0) for k in bands), (n, out, new)


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, ""), (2, None), (2, None)]])
def test_empty_tables(spark, make_docs, rows):
    docs = make_docs(rows, 1)
    assert exact_dedup.exact_dedup(spark, docs).count() == len(rows)
    assert line_dedup.line_dedup(spark, docs).count() == len(rows)
    assert substring_dedup.substring_dedup(spark, docs).count() == len(rows)
    assert {r["n_shingles"] for r in jaccard.jaccard_join(spark, docs).collect()} <= {0}


#: Two null ids, one of them a copy; an id with two texts, one of them a copy.
SHARED = [(None, "three"), (None, "alone and clean"), (3, "three"), (5, "A"), (9, "A"), (5, "B")]


def test_rows_of_one_id_have_their_own_verdict(spark, make_docs):
    kept = exact_dedup.keep_distinct(spark, make_docs(SHARED))
    assert got(kept, "doc_id", "text") == sorted(
        [(None, "alone and clean"), (3, "three"), (9, "A"), (5, "B")], key=repr)


def test_representatives_of_one_id(spark, make_docs):
    long = " ".join(f"w{k}" for k in range(60))
    near = long + " x"
    rows = [(None, near), (None, "alone and clean"), (4, long), (5, near), (5, "some other text")]
    kept = jaccard.keep_representatives(spark, make_docs(rows))
    assert got(kept, "doc_id", "text") == sorted(
        [(None, "alone and clean"), (4, long), (5, "some other text")], key=repr)

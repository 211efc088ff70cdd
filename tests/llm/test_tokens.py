"""Encoding, token files and token counts against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from sheetweave.llm import bpe, store, token_counts, token_files
from sheetweave.llm.bpe import tokenizer_path

ODD = ["", None, " ", "a", "  ", "<|endoftext|>x <|startoftext|>", "I'm don't 'S 12a b3 3.14", "é" * 3000, "ab" * 3000,
       "a.b," * 900, "<|endoftext|>" * 200, "ΑΣ Σ", "é x́", "x　y z", "x\x1cy\x85z", "İI ﬁ Ǆ",
       "don't" * 400, "1234567890" * 200, "漢字" * 1500, "Hello|world <b>", "ÀÖØößÿ÷×", "Été. Été, É", "﻿a"]


@pytest.fixture(scope="module")
def texts():
    chance = random.Random(1)
    small, long = "ab Z9'.,<|>é́ßΣ\n\t 中", "abZé9'.́"
    return (ODD + ["".join(chance.choice(small) for _ in range(chance.randint(0, 60))) for _ in range(300)]
            + ["".join(chance.choice(long) for _ in range(chance.randint(1000, 3000))) for _ in range(20)]
            + [" ".join(chance.choice(["the", "The.", "Über", "x,"]) for _ in range(400)) for _ in range(6)])


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(tokenizer_path())
    found.no_truncation()
    return found


def test_bpe(spark, make_docs, texts, library):
    found = {r["doc_id"]: r for r in bpe.bpe(make_docs(list(enumerate(texts))), tokenizer_path()).collect()}
    for k, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(found[k]["ids"], "<u4").tolist() == ids, repr(text)[:80]
        assert found[k]["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_joins_are_repaired(library):
    """Cuts at any place: repair gives the library's ids."""
    encoder, chance = bpe.Encoder(tokenizer_path()), random.Random(4)
    for _ in range(200):
        text = "".join(chance.choice("abé9'. ,Z") for _ in range(chance.randint(2, 60))).encode()
        cuts = sorted({c for c in (chance.randrange(1, len(text)) for _ in range(6)) if text[c] & 0xC0 != 0x80})
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        want = library.encode(text.decode(), add_special_tokens=False).ids
        assert np.frombuffer(encoder.repaired(parts), "<u4").tolist() == want


def test_chunks_follow_content():
    chance = random.Random(2)
    passage = " ".join(f"w{chance.randrange(999)}" for _ in range(600)).encode()
    a = {passage[i:j] for i, j in zip(*(lambda c: (c, c[1:]))(bpe.chunk_cuts(passage)[0]))}
    moved = b"some other start " + passage
    b = {moved[i:j] for i, j in zip(*(lambda c: (c, c[1:]))(bpe.chunk_cuts(moved)[0]))}
    assert len(a & b) >= len(a) - 1 > 3


def test_token_files(spark, make_docs, texts, library):
    rows = list(enumerate(texts)) + [(None, "no id"), (3, "again")]
    path = store.Store(spark).base + "-files"
    token_files.write_token_files(make_docs(rows), path, tokenizer_path(), end_id=2, shard=3000)
    found = token_files.read_token_files(spark, path).collect()
    expected, at = {}, 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        expected[(doc_id, at)] = zlib.crc32(ids.tobytes())
        at += len(ids)
    assert {(r["doc_id"], r["start"]): zlib.crc32(r["ids"]) for r in found} == expected


def test_token_files_of_nothing(spark, make_docs):
    path = store.Store(spark).base + "-empty"
    token_files.write_token_files(make_docs([], 1), path, tokenizer_path(), end_id=2)
    assert token_files.read_token_files(spark, path).count() == 0


def test_grammar_round_trip():
    chance = np.random.default_rng(3)
    for n, kinds in ((0, 1), (1, 1), (5, 1), (40_000, 3), (60_000, 50), (30_000, 20_000)):
        ids = chance.zipf(1.5, n).clip(1, kinds).astype("<u4")
        row = token_files.shard_row(0, 0, [], [], ids, 49_408)
        shard = token_files.Shard(*row[4:])
        assert (shard.ids() == ids).all()
        for _ in range(50):
            a, b = sorted(chance.integers(0, n + 1, 2).tolist())
            assert (shard.read_slice(a, b) == ids[a:b]).all()
    assert len(shard.symbols) <= n and len(token_files.compress(np.tile([1, 2, 3, 4], 9999).astype("<u4"), 10)[2]) < 10_000


def unigram(vocabulary):
    found = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False))
    found.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return found


def test_token_counts(spark, make_docs, texts):
    path = tokenizer_path("piece_bpe_32k.model")
    library = unigram(token_counts.ranked_vocabulary(path))
    found = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(make_docs(list(enumerate(texts))), path).collect()}
    assert found == {k: len(library.encode(t or "").ids) for k, t in enumerate(texts)}


def test_ties_and_unknowns():
    vocabulary = [("<unk>", 0.0), ("▁a", -1.0), ("a", -1.0), ("aa", -2.0), ("▁aa", -2.0), ("▁", -1.0), ("b", -1.5), ("ab", -2.5)]
    counter, library, chance = token_counts.Counter(vocabulary), unigram(vocabulary), random.Random(6)
    for _ in range(2000):
        text = "".join(chance.choice("aab xy▁") for _ in range(chance.randint(0, 14)))
        assert counter.count(text) == len(library.encode(text).ids), text


@pytest.mark.parametrize("ids, most", [
    (np.full(100_000, 7), 40), (np.tile(np.arange(64), 4000), 40), (np.array([5] * 7), 7), (np.array([], int), 0),
    (np.tile([1, 1, 2], 5000), 40), (np.tile(np.random.default_rng(4).integers(0, 99, 7000), 30), 1500), (np.random.default_rng(3).integers(0, 99, 5000), 5000)])
def test_grammars(monkeypatch, ids, most):
    """Repeats of any period shrink to a few symbols; rules and slices give the ids back."""
    rules, sizes, symbols = token_files.compress(ids, 100)
    shard = token_files.Shard(100, rules.tobytes(), sizes.tobytes(), 4, symbols.astype("<u4").tobytes())
    assert (shard.ids() == ids).all() and len(symbols) <= most
    monkeypatch.setattr(token_files, "TABLE", 0)
    assert all((x == y).all() for x, y in zip(token_files.compress(ids, 100), (rules, sizes, symbols)))
    for start, end in ((0, 0), (3, 90), (len(ids) // 2, len(ids))):
        fresh = token_files.Shard(100, rules.tobytes(), sizes.tobytes(), 4, symbols.astype("<u4").tobytes())
        assert (fresh.read_slice(start, min(end, len(ids))) == ids[start:min(end, len(ids))]).all()

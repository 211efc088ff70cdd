"""The stages of the pipeline on a small folder, each against a plain version of its rule."""

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from sheetweave.llm.bpe import tokenizer_path
from tests.llm import plain


@pytest.fixture(scope="module")
def folder(spark, make_docs, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    chance = [("the of and that with for was", "en"), ("der die und das nicht mit ist", "de")]
    labelled = [(1000 + k, " ".join(np.random.default_rng(k).permutation(t.split() * 3)), lang)
                for k, (t, lang) in enumerate(chance * 40)]
    docs = make_docs(corpus).unionByName(spark.createDataFrame(
        [(d, t, lang, "x", 1, b"k", 2, "h") for d, t, lang in labelled], make_docs(corpus).schema))
    docs.write.parquet(f"{path}/documents.parquet")
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        result = stage(spark, docs, folder)
        if name == "bpe":
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(tokenizer_path())
            found = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in result.collect()}
            assert found == {d: library.encode(t or "", add_special_tokens=False).ids for d, t in before}
            continue
        assert result.columns == docs.columns
        kept = sorted((r["doc_id"], r["text"]) for r in result.collect())
        texts = dict(before)
        if name == "language_id":
            letters = lambda t: any(map(str.isalpha, t or ""))
            assert [k for k, _ in kept] == sorted(d for d, t in before if letters(t))
        elif name == "exact_dedup":
            assert [k for k, _ in kept] == sorted(r[0] for r in plain.exact(before) if r[3])
        elif name == "ngram_jaccard":
            assert [k for k, _ in kept] == sorted(r[0] for r in plain.similar(before) if r[0] == r[2])
        else:
            assert [k for k, _ in kept] == sorted(texts)
        result.write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")


def test_run(spark, folder):
    result = corpus_pipeline.run(spark, folder)
    assert result.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    assert result.count() > 50
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_empty_corpus(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("number", range(1, 11))
def test_registered(number):
    assert sum(name.startswith(f"op{number}_") for name in entry.queries()) == 1

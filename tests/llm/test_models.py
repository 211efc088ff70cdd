"""Language identification, page extraction and decontamination."""

import html
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetweave.llm import boosting, decontamination, html_text, language_id
from sheetweave.llm.dom import blocks, parse

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return language_id.train(language_id.labelled(documents), sample_rows=600)


def test_language_of_held_out_rows(documents, model):
    found = language_id.identify(documents, model).join(documents.select("doc_id", "lang"), "doc_id")
    held = found.where(language_id.held_out()).select("lang", "lang_pred", "score").collect()
    assert len(held) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in held)
    assert found.where("rejected").count() == 0


def test_learns_only_from_what_it_may(documents):
    used = language_id.labelled(documents).select("doc_id", language_id.held_out().alias("h"))
    assert used.where("h").count() == 0
    assert used.count() == documents.count() - documents.where(language_id.held_out()).count()


def test_odd_texts(spark, make_docs, model):
    rows = [(1, None), (2, ""), (3, "12 34 -- ??"), (None, "the and of the"), (5, "中文"), (6, "x" * 300_000), (6, "the")]
    found = sorted(((r["doc_id"], r["lang_pred"], r["rejected"]) for r in
                    language_id.identify(make_docs(rows), model).collect()), key=repr)
    assert [f[1] for f in found if f[0] in (1, 2, 3)] == ["und"] * 3
    assert all(f[1] in model.languages for f in found if f[0] in (None, 5, 6))
    assert all(f[2] for f in found if f[1] == "und")


def test_identified_rows_of_one_id(spark, make_docs, documents, monkeypatch, model):
    """Rows without letters go alone, whatever shares their id."""
    monkeypatch.setattr(language_id, "train", lambda rows: model)
    rows = [(None, "12 34"), (None, "the and of the"), (7, None), (7, "the house of the people"), (8, "")]
    kept = language_id.keep_identified(spark, make_docs(rows))
    assert kept.columns == make_docs(rows).columns
    assert sorted(r["text"] for r in kept.collect()) == ["the and of the", "the house of the people"]


def test_foreign_texts_are_rejected(spark, make_docs, documents, model):
    """Unlearned languages, shuffled letters and gibberish go; held-out rows of the tables stay."""
    chance = random.Random(4)
    clean = [r["text"] for r in documents.where(language_id.held_out() & (F.length("text") > 200)).limit(40).collect()]
    foreign = ["这是一个中文文件，里面没有任何其他语言的内容。", "Вот русский текст, которого модель никогда не видела",
               "Tämä on suomenkielinen teksti jota malli ei ole koskaan nähnyt",
               "Ez egy magyar szöveg amelyet a modell soha nem látott",
               "".join(chance.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)),
               *("".join(chance.sample(t, len(t))) for t in clean)]
    rows = [(k, t) for k, t in enumerate(clean + foreign)]
    found = language_id.identify(make_docs(rows), model).collect()
    assert len(clean) == 40
    assert {r["doc_id"]: r["rejected"] for r in found} == {k: k >= len(clean) for k, _ in rows}


def test_repeated_words(spark, documents):
    """Texts of one word, thousands of times, and rows of one id neither break nor fill the training."""
    chance = random.Random(9)
    odd = [(None if k % 2 else 5, " ".join([chance.choice(["lorem", "xyz", "ababab", "qq"])] * 3000), "en") for k in range(400)]
    odd += [(77, "one line of a row that comes again and again", "en")] * 3000
    mixed = documents.select("doc_id", "text", "lang").unionByName(
        spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    model = language_id.train(language_id.labelled(mixed), sample_rows=4000)
    assert np.isfinite(model.logits).all()
    found = language_id.identify(documents, model).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found)
    repeated = [language_id.subwords("lorem ipsum " * 20 + "xyz " * 5000)] * 2
    data = [(k % 3, *np.unique(repeated[0], return_counts=True)) for k in range(300)]
    data = [(label, bucket, (count / count.sum()).astype(np.float32), "whole") for label, bucket, count in data]
    assert np.abs(language_id.descend(data, 3, np.random.default_rng(1))).max() < 1000


def test_nothing_to_learn(spark, make_docs):
    docs = make_docs([(0, None), (1, "text")]).withColumn("lang", F.lit(None).cast("string"))
    model = language_id.train(language_id.labelled(docs))
    assert {r["lang_pred"] for r in language_id.identify(docs, model).collect()} == {"und"}


def test_boosting_learns():
    chance = np.random.default_rng(2)
    x = chance.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 1] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = boosting.fit(x[:2000], y[:2000])
    assert np.mean((trees.logits(x[2000:]) > 0) == y[2000:]) > 0.97


@pytest.fixture(scope="module")
def extractor(spark):
    return html_text.train(spark.read.parquet(f"{FOLDER}/pages.parquet"))


def article(page):
    """Blocks of the article by plain search, for pages with an article element."""
    found = re.search(r"<article>(.*?)</article>", page, re.S)
    parts = re.split(r"</?(?:p|h1|br|li|ul)\b[^>]*>", found[1]) if found else []
    texts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in parts]
    return "\n".join(t for t in texts if t)


def test_pages(spark, extractor):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    found = {r["page_id"]: r["text"] for r in html_text.extract(pages, extractor).collect()}
    assert found == {k: article(v) for k, v in source.items()}


def test_layouts(extractor):
    """Other markup than the tables have: nearly all text gets the right side."""
    chance, right, total = random.Random(77), 0, 0
    for _ in range(150):
        tree, labels = html_text.laid_out(html_text.layout(chance, "alpha beta gamma delta".split()))
        logits = extractor.trees.logits(html_text.Features(extractor.tokens).of(tree))
        kept = html_text.decode(tree.parents, logits.tolist())
        for v in range(1, len(labels)):
            if labels[v] is not None and tree.own[v]:
                right, total = right + (kept[v] == bool(labels[v])), total + 1
            assert not kept[v] or kept[tree.parents[v]]
    assert right / total > 0.97


def test_odd_pages(spark, extractor):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<"), (4, "u", "<p>un<b>closed"), (5, "u", "plain &amp; text"),
            (6, "u", "<article><p>a&nbsp;b\n c<br>d<script>x</script></article>"), (7, "u", "<div>" * 3000 + "deep"),
            (8, "u", "<article>" + "<p>word</p>" * 5000 + "</article>"), (8, "u", "<nav>a</nav>")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, h int")
    found = html_text.extract(pages, extractor).collect()
    assert len(found) == len(rows)
    by_id = {r["page_id"]: r["text"] for r in found if r["page_id"] != 8}
    assert by_id[1] == by_id[2] == "" and by_id[6] == "a b c\nd"
    assert {len(r["text"]) for r in found if r["page_id"] == 8} == {0, 5 * 5000 - 1}
    assert html_text.extract(pages.limit(0), extractor).count() == 0


def test_blocks():
    tree = parse("<div>a <b>b</b>c<ul><li>d<li>e</ul>f<p>g<p>h<div>i</div><!-- x -->j&eacute;</div>k")
    assert blocks(tree, [True] * len(tree.tags)) == ["a bc", "d", "e", "f", "g", "h", "i", "jé", "k"]


@pytest.mark.parametrize("page, expected", [
    ('<p>a<svg viewBox="0 0 1 1"/>b</p><p>c</p>', ["ab", "c"]),
    ("<p>a<svg/>b<svg><text>no</text></svg>c</p>", ["abc"]),
    ("<p>a<svg><svg><text>no</text></svg>no</svg>b</p>", ["ab"]),
    ("<p>a<svg>b</p><p>c<svg><text>no</text></svg>d</p>", ["ab", "cd"]),
    ("<p>a<iframe src='x'>b</p><p>c</p>", ["ab", "c"]),
    ("<p>a<iframe src='x'>no</iframe>b</p><p>c</p>", ["ab", "c"]),
    ("<p>a<object>b</p>c<noscript>d<template>e<select>f", ["ab", "cdef"]),
    ("<p>a<script/>no</script>b<style>no</p>no", ["ab"]),
    ("<p>a" + "<svg>" * 20_000 + "b" + "<iframe>" * 20_000 + "c", ["abc"]),
])
def test_raw_elements(page, expected):
    tree = parse(page)
    assert blocks(tree, [True] * len(tree.tags)) == expected


def test_decoding_is_best():
    chance = random.Random(3)
    for _ in range(100):
        n = 8
        parents = [-1] + [chance.randrange(v) for v in range(1, n)]
        logits = [0.0] + [chance.uniform(-3, 3) for _ in range(1, n)]
        best = max(sum(logits[v] for v in range(1, n) if pick >> v & 1) for pick in range(1 << n)
                   if pick & 1 and all(not pick >> v & 1 or pick >> parents[v] & 1 for v in range(1, n)))
        kept = html_text.decode(parents, logits)
        assert sum(x for x, k in zip(logits, kept) if k) == pytest.approx(best)


QUESTION = "so: If Anna buys {a} apples for {b} dollars and then sells {c} apples to {n}, how much does she earn in total today?"


def test_templates(spark, make_docs):
    rows = [
        (1, "Intro text. " + QUESTION.format(a=12, b=30, c=12, n="Bob") + " More text follows here."),
        (2, QUESTION.format(a=7, b="99.5", c=7, n="Dan").replace("Anna", "Carla")),
        (3, QUESTION.format(a=7, b=99, c=8, n="Dan")),  # one number stands for two
        (4, None), (None, ""), (5, "short"), (6, "If Anna buys 12 apples for 30 dollars"),
        (8, "x y z. If Anna buys 12 apples for 30 dollars and then sells 12 apples to Bob today"),
        (7, "x " * 200_000 + QUESTION.format(a=1, b=2, c=1, n="Eve")), (7, "other text of the same id")]
    items = spark.createDataFrame(
        [(9, QUESTION.format(a=12, b=30, c=12, n="Bob")[4:], 1), (10, None, 2), (11, "few", 3), (9, QUESTION.format(a=12, b=30, c=12, n="Bob")[4:], 1)],
        "item_id long, text string, doc_id long")
    found = {r["doc_id"]: (r["contaminated"], r["item_id"]) for r in
             decontamination.contaminated(spark, make_docs(rows), items).collect()}
    assert found == {1: (True, 9), 2: (True, 9), 3: (False, None), 4: (False, None), None: (False, None),
                     5: (False, None), 6: (False, None), 7: (True, 9), 8: (True, 9)}
    kept = decontamination.keep_clean(spark, make_docs(rows), items)
    assert kept.columns == make_docs(rows).columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 4, 5, 6]
    assert decontamination.contaminated(spark, make_docs(rows), items.limit(0)).where("contaminated").count() == 0
    assert decontamination.contaminated(spark, make_docs([], 1), items).count() == 0


def verdicts(spark, make_docs, rows, items):
    items = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contaminated(spark, make_docs(rows), items).collect()
    return {r["doc_id"]: (r["contaminated"], r["n_items"], r["item_id"]) for r in found}


def test_verbatim_windows_of_torn_slots(spark, make_docs):
    """One occurrence of a repeated number is changed; six usable windows stay as they are."""
    rows = [(1, QUESTION.format(a=12, b=30, c=13, n="Bob")), (2, QUESTION.format(a=7, b=99, c=8, n="Dan"))]
    items = [(9, QUESTION.format(a=12, b=30, c=12, n="Bob")[4:])]
    assert verdicts(spark, make_docs, rows, items) == {1: (True, 1, 9), 2: (False, 0, None)}


NAMED = ("every day in the early spring near Oslo the old man met with Peter to talk over stra\u00dfe and river boats")


def test_wrapping_and_case(spark, make_docs):
    rows = [(1, NAMED.replace(" Oslo", "\nOslo").replace(" Peter", "  Peter")), (2, NAMED.lower()), (3, NAMED.upper()),
            (4, NAMED.replace(" Oslo", "\u00a0Oslo").replace("Peter", "Simon")), (5, NAMED[:30])]
    assert verdicts(spark, make_docs, rows, [(9, NAMED)]) == {
        **{k: (True, 1, 9) for k in (1, 2, 3, 4)}, 5: (False, 0, None)}


def test_all_texts_of_an_item(spark, make_docs):
    texts = [" ".join(f"{letter}{chr(97 + k)}" for k in range(12)) for letter in "pqrs"]
    items = [(9, texts[0]), (9, texts[1]), (None, texts[2]), (4, texts[3]), (9, None), (None, texts[2])]
    rows = [(1, texts[0]), (2, texts[1]), (3, texts[2]), (4, " x ".join(texts)), (5, texts[0] + " . " + texts[1]), (6, "x")]
    assert verdicts(spark, make_docs, rows, items) == {
        1: (True, 1, 9), 2: (True, 1, 9), 3: (True, 1, None), 4: (True, 3, 4), 5: (True, 1, 9), 6: (False, 0, None)}


def test_passages(spark):
    """Verbatim items in the tables: by plain search for runs of words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    plain = lambda t: re.findall(r"[^\W_]+", t.lower())
    runs = {}
    for r in items.collect():
        w = plain(r["text"])
        for k in range(len(w) - 7):
            runs.setdefault(tuple(w[k:k + 8]), (r["item_id"], len(w) - 7))
    expected = set()
    for r in docs.collect():
        w, hit = plain(r["text"] or ""), {}
        for k in range(len(w) - 7):
            item = runs.get(tuple(w[k:k + 8]))
            if item:
                hit.setdefault(item, set()).add(tuple(w[k:k + 8]))
        if any(len(h) >= min(0.5 * n, 6) for (_, n), h in hit.items()):
            expected.add(r["doc_id"])
    found = decontamination.contaminated(spark, docs, items).where("contaminated").collect()
    assert {r["doc_id"] for r in found} == expected and expected


def test_short_items(spark, make_docs):
    """An item shorter than a window meets documents that are just that, by words or by template."""
    items = [(1, "What is the capital of France?"), (2, "Paris"), (3, "?!"), (4, "How many days has Anna to pay 12 dollars")]
    rows = [(1, "what is the  capital\nof FRANCE"), (2, "What is the capital of France? Paris"), (3, "paris."), (4, "!"),
            (5, ""), (6, "What is the capital of Spain?"), (7, "Paris is what I think the capital of France may be, he said"),
            (8, "How many days has Carla to pay 7 dollars"), (9, "the capital of France")]
    found = verdicts(spark, make_docs, rows, items)
    assert {k: v[2] for k, v in found.items() if v[0]} == {1: 1, 3: 2, 6: 1, 8: 4}

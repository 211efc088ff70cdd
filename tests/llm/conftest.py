import random

import pytest


@pytest.fixture(scope="session")
def make_docs(spark):
    """A table of (doc_id, text) rows, with columns whose names the operators use inside."""

    def make(rows, parts=3):
        full = [(d, t, "en", "x", 1, b"k", 2, "h") for d, t in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, key binary, cid long, h string"
        ).repartition(parts)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Random texts with exact and near copies, shared passages and lines, a hot group, and
    odd texts."""
    chance = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)] + ["Über", "ÉTÉ", "a.b", "中文"]

    def prose(n):
        return " ".join(chance.choice(vocabulary) + chance.choice(["", "", ".", "\n"]) for _ in range(n))

    base = [prose(chance.choice([3, 8, 40, 60, 120, 300])) for _ in range(60)]
    texts = list(base)
    for _ in range(60):
        near = chance.choice(base).split(" ")
        for _ in range(max(1, len(near) // chance.choice([8, 15, 25, 60]))):
            near[chance.randrange(len(near))] = chance.choice(vocabulary)
        texts.append(" ".join(near))
    hot = prose(150)
    texts += [hot] * 25
    for _ in range(25):
        near = hot.split(" ")
        for _ in range(chance.randrange(1, 12)):
            near[chance.randrange(len(near))] = chance.choice(vocabulary)
        texts.append(" ".join(near))
    passage, line = prose(70), "This line stands in MANY documents, É."
    texts += [prose(30) + " " + passage + " " + prose(20) for _ in range(10)]
    texts += [f"{prose(5)}\n \t{line}\r\n{prose(3)}" for _ in range(12)] + [f"{line.upper()}\nx", f"{line}\n{line}"]
    texts += ["", None, " ", "\n\n", "one", "One", "w1 w2 w3", "W1  w2\tw3", "z" * 5000, prose(9000)]
    chance.shuffle(texts)
    return list(enumerate(texts))

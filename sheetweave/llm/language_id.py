"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is lower-cased, all but letters and bytes above 127 become word ends, and each run of
2, 3 and 4 bytes is hashed to a row of an embedding table. The rows are averaged and go
through a linear layer. Both are trained by stochastic gradient descent in numpy on a
bounded sample of labelled rows; the sample's features are counted in Spark tasks. As
everything up to the softmax is linear, prediction adds one row of logits per subword.

Calibration: a part of the sample is held back from training. On it a temperature is
fitted, and the score below which a text is rejected: ``margin`` times the smallest score
of a right answer there. As a softmax is sure of foreign texts too, a text is also rejected
by the share of its distinct subwords that training met. Its limit lies midway between the
``LOW`` quantile of whole held-back texts and the 1 - ``LOW`` quantile of texts out of class:
held-back texts with their language left out, and sampled texts with shuffled letters. If these
overlap, the limit is the ``LOW`` quantile. A text's share must lie below the limit by three
standard errors of a share of as many subwords. Texts of fewer than ``JUDGED`` distinct subwords,
about eight words, say too little and are judged by the score alone.

Defined results: ``und`` with score 0 for null texts and texts without a letter, and if
nothing could be learned. A text with letters gets a learned language, rejected or not. Ties go to the
language first in order. Repeated rows get equal results. Other columns are not read by a
prediction; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from sheetweave.llm.texts import filter_rows, map_rows

#: Rows of the embedding table, its width, and the seed of its start.
BUCKETS, WIDTH, SEED = 1 << 15, 16, 7
#: Expected number of labelled rows that train the model, whatever the table's size.
SAMPLE_ROWS = 4000
#: Short pieces of each sampled text that are learned besides the whole.
PIECES, EPOCHS, RATE = 2, 6, 0.5
#: Quantile of the limit, distinct subwords that it needs, and of how many sampled texts one
#: has the letters of its first characters shuffled.
LOW, JUDGED, SHUFFLED, SHUFFLED_CHARS = 0.005, 100, 8, 20_000

_TO_SPACE = bytes(c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))


def subwords(text: str) -> np.ndarray:
    """Bucket numbers of all subwords of a text, repeated as they occur."""
    words = text.lower().encode("utf-8", "replace").translate(_TO_SPACE).split()
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    held, found = raw, []
    for size in (2, 3, 4):
        if len(raw) < size:
            break
        held = held[:-1] * np.uint32(257) + raw[size - 1:]
        spread = held * np.uint32(2654435761) + np.uint32(size * 40503)
        found.append(spread >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # one row per bucket
    temperature: float
    threshold: float
    known: np.ndarray  # buckets that training met
    limit: float  # least share of known ones

    def scores(self, found: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.languages))
        for start in range(0, len(found), 1 << 18):
            total += self.logits[found[start:start + (1 << 18)]].sum(axis=0, dtype=np.float64)
        return softmax(total / max(len(found), 1) / self.temperature)

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether the text is rejected."""
        if not self.languages or not has_letter(text):
            return "und", 0.0, True
        found = subwords(text)
        scores = self.scores(found)
        best = int(scores.argmax())
        share, number = familiar(found, self.known)
        strange = share < self.limit - 3 * (self.limit * (1 - self.limit) / max(number, 1)) ** 0.5
        return self.languages[best], float(scores[best]), bool(scores[best] < self.threshold or strange)

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]


def familiar(found: np.ndarray, known: np.ndarray) -> tuple[float, int]:
    """Share of the distinct subwords that are known, 1 for fewer than ``JUDGED``, and their number."""
    own = np.zeros(BUCKETS, np.bool_)
    own[found] = True
    number = np.count_nonzero(own)
    return np.count_nonzero(own & known) / number if number >= JUDGED else 1.0, number


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def _examples(rows):
    """Bucket counts of a whole text and of short pieces of it, chosen by the id, and of some
    texts with shuffled letters."""
    for doc_id, text, lang in rows:
        words = text.split()
        seed = np.random.default_rng(abs(hash((doc_id or 0, 17))) % (1 << 32))
        texts = [text]
        for _ in range(PIECES if len(words) > 4 else 0):
            size = int(seed.integers(2, 13))
            start = int(seed.integers(0, max(1, len(words) - size)))
            texts.append(" ".join(words[start:start + size]))
        kinds = ["whole"] + ["piece"] * (len(texts) - 1)
        if seed.integers(0, SHUFFLED) == 0:
            texts.append("".join(seed.permutation(list(text[:SHUFFLED_CHARS]))))
            kinds.append("shuffled")
        for piece, kind in zip(texts, kinds):
            if has_letter(piece):
                bucket, count = np.unique(subwords(piece), return_counts=True)
                yield lang, bucket.astype("<u2").tobytes(), count.astype("<u4").tobytes(), kind


def labelled(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: label present, and crc32 of the id not 2 modulo 4."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def train(labelled_rows: DataFrame, sample_rows: int = SAMPLE_ROWS, margin: float = 0.5) -> Model:
    """Fits on about ``sample_rows`` rows of (doc_id, text, lang): those whose hash of all three falls
    below a share of all hashes, so the sample does not hang on the partitioning. Of rows alike in
    all three one is learned, so a row that is repeated millions of times does not fill the driver."""
    share = min(1.0, sample_rows / max(1, labelled_rows.select("doc_id").count()))
    own = F.xxhash64(F.col("doc_id"), F.col("text"), F.col("lang"), F.lit(SEED))
    drawn = (labelled_rows.select("doc_id", "text", "lang", own.alias("own"))
             .where(F.pmod("own", F.lit(1 << 30)) <= int(share * (1 << 30))))
    rows = map_rows(drawn.dropDuplicates(["own"]).select("doc_id", "text", "lang"), _examples,
                    "lang string, buckets binary, counts binary, kind string").collect()
    shuffled = [np.frombuffer(r["buckets"], "<u2") for r in rows if r["kind"] == "shuffled"]
    rows = sorted(r for r in rows if r["kind"] != "shuffled")
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), 1.0, 0.0, np.zeros(BUCKETS, np.bool_), 0.0)
    data = []
    while rows:
        lang, bucket, count, kind = rows.pop()
        count = np.frombuffer(count, "<u4").astype(np.float32)
        data.append((languages.index(lang), np.frombuffer(bucket, "<u2"), count / count.sum(), kind))
    chance = np.random.default_rng(SEED)
    chance.shuffle(data)
    held_back = data[::5] if len(data) >= 50 else data
    learned = [d for k, d in enumerate(data) if k % 5] if len(data) >= 50 else data
    logits = descend(learned, len(languages), chance)
    met = np.zeros((len(languages), BUCKETS), np.bool_)
    for label, bucket, _, _ in learned:
        met[label, bucket] = True
    limit = least_familiar(met, held_back, shuffled) if held_back is not learned else 0.0
    return calibrated(languages, logits, held_back, margin, met.any(axis=0), limit)


def least_familiar(met: np.ndarray, held_back: list, shuffled: list) -> float:
    """The share of known subwords below which a text is rejected; ``met`` has the buckets that
    training met in each language."""
    known = met.any(axis=0)
    whole = [(label, bucket) for label, bucket, _, kind in held_back if kind == "whole" and len(bucket) >= JUDGED]
    if not whole:
        return 0.0
    low = float(np.quantile([familiar(bucket, known)[0] for _, bucket in whole], LOW))
    foreign = [familiar(bucket, known)[0] for bucket in shuffled if len(bucket) >= JUDGED]
    if len(met) > 1:
        others = [np.delete(met, label, axis=0).any(axis=0) for label in range(len(met))]
        foreign += [familiar(bucket, others[label])[0] for label, bucket in whole]
    high = float(np.quantile(foreign, 1 - LOW)) if foreign else 0.0
    return min(low, (low + high) / 2)


def descend(data: list, classes: int, chance: np.random.Generator) -> np.ndarray:
    """Plain SGD over single examples with a falling rate; returns embeddings times weights."""
    table = chance.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weights = chance.normal(0, 0.1, (WIDTH, classes)).astype(np.float32)
    bias = np.zeros(classes, np.float32)
    steps, done = EPOCHS * len(data), 0
    for _ in range(EPOCHS):
        for k in chance.permutation(len(data)):
            label, bucket, share, _ = data[k]
            rate = np.float32(RATE * (1 - done / steps))
            rows = table[bucket]
            mean = share @ rows
            slope = softmax(mean @ weights + bias).astype(np.float32)
            slope[label] -= 1
            back = weights @ slope
            back /= max(np.float32(1), np.linalg.norm(back))
            weights -= rate * np.outer(mean, slope)
            bias -= rate * slope
            # The step is spread over the rows in the mean so that the mean moves by just the slope,
            # at most 1, whatever the words' shares: one repeated word takes no larger step than many.
            table[bucket] = rows - rate * np.outer(share / (share @ share), back)
            done += 1
    logits = table @ weights + bias
    if not np.isfinite(logits).all():
        raise ArithmeticError("training of the language model diverged")
    return logits


def calibrated(languages: list[str], logits: np.ndarray, held_back: list, margin: float,
               known: np.ndarray, limit: float) -> Model:
    means = np.array([share @ logits[bucket] for _, bucket, share, _ in held_back])
    labels = np.array([label for label, *_ in held_back])

    def chances(temperature):
        z = means / temperature
        z -= z.max(axis=1, keepdims=True)
        return np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)

    losses = {t: -np.log(chances(t)[np.arange(len(labels)), labels] + 1e-9).mean()
              for t in np.geomspace(0.02, 5, 60)}
    temperature = min(losses, key=losses.get)
    scores = chances(temperature)
    right = scores.max(axis=1)[scores.argmax(axis=1) == labels]
    threshold = margin * float(right.min()) if len(right) else 0.0
    return Model(languages, logits.astype(np.float32), float(temperature), threshold, known, limit)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def work(rows):
        model = known.value
        for doc_id, text in rows:
            yield doc_id, *model.judge(text)

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work,
                    "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows whose language is recognised, with all their columns. Each row is judged by its
    own text in the pass that hands it on, whatever its id."""
    known = spark.sparkContext.broadcast(train(labelled(docs)))
    return filter_rows(docs, "text", lambda text: not known.value.judge(text)[2])


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = identify(docs, train(labelled(docs)))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

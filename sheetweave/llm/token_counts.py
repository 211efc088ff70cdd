"""Token counts of a unigram vocabulary, by Aho-Corasick and a count-only Viterbi pass.

Words are taken as the tokenizer takes them: text is split at spaces, and each word starts
with the mark ``\\u2581``. An Aho-Corasick automaton finds all vocabulary pieces that end at
a character; dynamic programming keeps, for each end, the best score, the number of pieces
on that path, and whether the last is unknown. Rules of ties and unknown characters are those
of the tokenizers library: of equal scores the piece that starts first stays; a character
that starts no one-character piece may be unknown, at the lowest score less 10; unknown
neighbours count once. Scores add up in the library's order, in 64-bit floats.

The vocabulary is that of a public tokenizer file; its pieces are scored by rank, as -log of
it. Nothing is trained. Each distinct word is counted once in a worker, in a bounded cache.

Defined results: null and empty texts have no tokens. Repeated rows get equal results. Other
columns are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from sheetweave.llm.bpe import Generations, tokenizer_path
from sheetweave.llm.store import id_text
from sheetweave.llm.texts import map_rows

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 400_000


def ranked_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file with a score by rank; the unknown piece comes first,
    control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return [("<unk>", 0.0)] + [(piece, -math.log(rank + 2)) for rank, piece in enumerate(pieces)]


class Counter:
    """Counts pieces of words; ``vocabulary`` has the unknown piece at 0."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary[1:]:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.words = Generations(self.count_word, CACHED_WORDS)

    def count_word(self, word: str) -> int:
        """Pieces on the best path of one word."""
        size = len(word)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        single = [False] * size
        for end, (length, score) in self.automaton.iter(word):
            matches[end].append((end - length + 1, score))
            single[end] |= length == 1
        best, pieces, open_end = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        for end in range(size):
            found = None
            # From the earliest start on; an unknown character comes where its one-character piece would.
            steps = sorted(matches[end])
            if not single[end]:
                steps.append((end, None))
            for start, score in steps:
                total = best[start] + (self.unknown if score is None else score)
                if found is None or total > found:
                    found = total
                    known = score is not None
                    best[end + 1], open_end[end + 1] = total, not known
                    pieces[end + 1] = pieces[start] + (known or not (open_end[start] and start))
        return pieces[size]

    def count(self, text: str) -> int:
        words = text.replace(" ", MARK)
        if not words.startswith(MARK):
            words = MARK + words
        get = self.words.__getitem__
        return sum(map(get, [MARK + w for w in words.split(MARK)[1:]])) if text else 0


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(ranked_vocabulary(path))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens for each row."""

    def work(rows):
        known = counter(path)
        for doc_id, text in rows:
            yield doc_id, known.count(text)

    return map_rows(id_text(docs), work, "doc_id long, n_tokens long")


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{folder}/documents.parquet"), tokenizer_path("piece_bpe_32k.model"))

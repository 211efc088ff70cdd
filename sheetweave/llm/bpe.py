"""BPE encoding that reuses content-defined chunks, and decoding.

A text is cut into chunks where a rolling hash of the last eight bytes meets a mask, so
equal passages give equal chunks wherever they stand. A task encodes each distinct chunk
once, word by word, with the tokenizers library, and joins the ids of the chunks. A join
between white space and a word is exact by the tokenizer's rules: no piece crosses white
space. Every other join (inside words longer than ``LONGEST`` bytes, or at special tokens)
is repaired: both sides are encoded together, and if that differs from the sum of the
sides, the joint ids replace them and the next join is checked against the joint chunk.

Chunks are shared within a task; sharing them over all tasks would move the whole text by
a shuffle. Both caches are bounded in entries; forgetting costs time only.

Defined results: null and empty texts have no ids and decode to an empty string. Repeated
rows give repeated results. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from codecs import charmap_decode
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from sheetweave.llm.store import id_text
from sheetweave.llm.texts import map_rows

#: A cut follows white space where the hash has these bits clear; about every 32nd word.
MASK = 31
#: Bytes from which a word without white space is cut at hashes alone.
LONGEST = 1024
#: Entries of each of the two generations of a cache.
CACHED_CHUNKS, CACHED_WORDS = 10_000, 150_000

SPECIAL = re.compile(rb"<\|(?:startoftext|endoftext)\|>")
#: Letters of ASCII and Latin-1, which no normal form changes, and ASCII marks after them.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=?@\\[-`{}~]*)")

plain_word = PLAIN.fullmatch


def byte_letters() -> str:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for
    the code points from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in own else chr(next(rest)) for b in range(256))


class Generations(dict):
    """A bounded cache: when full, the young generation becomes the old one."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers, whatever the machine."""
    values = array("I", ids)
    if sys.byteorder == "big":
        values.byteswap()
    return values.tobytes()


def white(byte: int) -> bool:
    return byte == 32 or 9 <= byte <= 13


class Encoder:
    """Encodes and decodes as one tokenizer file says. Made once in each Python worker."""

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pieces = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.alphabet = byte_letters()
        self.tokenize = self.tokenizer.model.tokenize
        self.words = Generations(self.encode_word, cached_words)
        self.marks = Generations(self.encode_letters, cached_words // 8)
        self.chunks = Generations(self.encode_chunk, CACHED_CHUNKS)

    def forget(self) -> None:
        """Empties the caches, so that a worker that waits for other work holds little."""
        for cache in (self.words, self.marks, self.chunks):
            cache.clear()
            cache.old = {}

    def whole(self, data: bytes) -> bytes:
        """The library's ids of a string, as little-endian unsigned 32-bit integers."""
        return packed(self.tokenizer.encode(data.decode("utf-8"), add_special_tokens=False).ids)

    def encode_letters(self, piece: bytes) -> bytes:
        """One pre-token, lower-cased, in UTF-8: the model alone decides."""
        return packed([t.id for t in self.tokenize(charmap_decode(piece, "strict", self.alphabet)[0])])

    def encode_word(self, word: bytes) -> bytes:
        """Letters followed by marks are two pre-tokens; anything else goes the full way."""
        if len(word) > LONGEST:
            return self.whole(word)
        if word.isalpha():
            return self.encode_letters(word.lower())
        if word[:-1].isalpha() and word[-1] in b".,":
            letters = word[:-1].lower()
            return (self.words.get(letters) or self.encode_letters(letters)) + self.marks[word[-1:]]
        plain = plain_word(word.decode("utf-8"))
        if plain is None:
            return self.whole(word)
        ids = self.encode_letters(plain[1].lower().encode("utf-8"))
        return ids + self.marks[plain[2].encode("ascii")] if plain[2] else ids

    def encode_chunk(self, chunk: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, chunk.split()))

    def encode(self, data: bytes) -> bytes:
        cuts, inside = chunk_cuts(data)
        edges = zip([0, *cuts], [*cuts, len(data)])
        chunks = self.chunks
        if inside:
            return self.repaired([data[a:b] for a, b in edges])
        return b"".join([chunks[data[a:b]] for a, b in edges])

    def repaired(self, parts: list[bytes]) -> bytes:
        """Joins chunks left to right, re-encoding across a join until both ways agree."""
        out, last, ids = [], parts[0], self.chunks[parts[0]]
        for part in parts[1:]:
            right = self.chunks[part]
            safe = not last or not part or white(last[-1]) or white(part[0])
            joint = None if safe else self.whole(last + part)
            if safe or joint == ids + right:
                out.append(ids)
                last, ids = part, right
            else:
                last, ids = last + part, joint
        return b"".join([*out, ids])

    def decode(self, ids: bytes) -> str:
        """Without a decoder in its file, the library joins the pieces with spaces."""
        pieces = self.pieces
        return " ".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


def chunk_cuts(data: bytes) -> tuple[list[int], bool]:
    """Places where a chunk ends, and whether any lies inside a word. Cuts follow white space
    by the rolling hash; inside words only beyond LONGEST bytes without white space, and then
    not inside a character or special token."""
    raw = np.frombuffer(data, np.uint8)
    blank = np.flatnonzero((raw == 32) | ((raw >= 9) & (raw <= 13)))
    at = blank[blank >= 7] + 1
    rolled = np.zeros(len(at), np.uint32)
    for k in range(8, 0, -1):
        rolled = rolled * np.uint32(0x01000193) + raw[at - k]
    rolled ^= rolled >> np.uint32(15)
    cuts = at[(rolled & np.uint32(MASK)) == 0]
    gaps = np.diff(blank, prepend=-1, append=len(raw))
    if gaps.max() <= LONGEST:
        return cuts.tolist(), False
    ends = np.append(blank, len(raw))[gaps > LONGEST]
    starts = ends - gaps[gaps > LONGEST] + 1
    inner = np.concatenate([inner_cuts(raw, a, b) for a, b in zip(starts.tolist(), ends.tolist())])
    for special in SPECIAL.finditer(data):
        inner = inner[(inner <= special.start()) | (inner >= special.end())]
    return np.unique(np.concatenate((cuts, inner))).tolist(), True


def inner_cuts(raw: np.ndarray, start: int, end: int) -> np.ndarray:
    """Cuts of one over-long chunk by the hash alone, at starts of characters."""
    at = np.arange(start + 8, end)
    at = at[(raw[at] & 0xC0) != 0x80]
    rolled = np.zeros(len(at), np.uint32)
    for k in range(8, 0, -1):
        rolled = rolled * np.uint32(0x01000193) + raw[at - k]
    return at[((rolled ^ (rolled >> np.uint32(13))) & np.uint32(255)) == 0]


@lru_cache(maxsize=4)
def encoder(path: str, cached_words: int = CACHED_WORDS) -> Encoder:
    return Encoder(path, cached_words)


def bpe(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers as bytes), decoded."""

    def work(rows):
        bpe = encoder(path)
        for doc_id, text in rows:
            ids = bpe.encode(text.encode("utf-8"))
            yield doc_id, ids, bpe.decode(ids)
        bpe.forget()

    return map_rows(id_text(docs), work, "doc_id long, ids binary, decoded string")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer files lie, on the driver and on each executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return digests(bpe(spark.read.parquet(f"{folder}/documents.parquet"), tokenizer_path()))

"""Helpers inside tasks: rows of Arrow batches, and words of a text as numpy arrays.

Words are maximal runs of bytes that are not ASCII white space. Word hashes are 64-bit
polynomials of the bytes, mixed; hashes of word sequences combine them. All arithmetic is
modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows or bytes after which results go back to Spark.
FLUSH_ROWS, FLUSH_BYTES = 2048, 4 << 20
#: Bytes of an Arrow batch that goes to Python.
BATCH_BYTES = 4 << 20
#: Bytes of one text that are hashed at a time.
SLICE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD6E8FEB86659FD93
_POWERS = np.cumprod(np.full(64, _BASE, np.uint64))


def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):  # few Python objects at a time
            yield from zip(*(column.to_pylist() for column in batch.slice(start, 256).columns))


def map_rows(df: DataFrame, work: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """mapInArrow over rows; ``work`` turns the rows of a task into rows of ``schema``.
    Results leave in small batches, so a task holds little at a time."""
    bound_batches(df)
    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    target = to_arrow_schema(parsed)

    def run(batches):
        held, size = [], 0
        for row in work(rows(batches)):
            held.append(row)
            size += sum(x.nbytes if isinstance(x, np.ndarray) else len(x)
                        for x in row if isinstance(x, (bytes, str, np.ndarray)))
            if len(held) >= FLUSH_ROWS or size >= FLUSH_BYTES:
                yield _batch(held, target)
                held, size = [], 0
        if held:
            yield _batch(held, target)

    return df.mapInArrow(run, parsed)


def filter_rows(df: DataFrame, column: str, keep: Callable[[object], bool]) -> DataFrame:
    """The rows whose value of ``column`` passes ``keep``, with all their columns as they are."""
    bound_batches(df)
    place = df.columns.index(column)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # few Python objects at a time
                part = batch.slice(start, 256)
                yield part.filter(pa.array(map(keep, part.column(place).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def bound_batches(df: DataFrame) -> None:
    """Limits the session's Arrow batches to ``BATCH_BYTES``: rows are whole documents here, and
    Spark and Python hold several batches for each task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    df.sparkSession.conf.set(name, BATCH_BYTES)


def _batch(held: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [_column(values, field.type) for values, field in zip(zip(*held), target)], schema=target)


def _column(values, kind) -> pa.Array:
    if pa.types.is_list(kind) and all(isinstance(x, np.ndarray) for x in values):
        ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
        flat = np.concatenate(values).astype(kind.value_type.to_pandas_dtype(), copy=False)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), type=kind)
    return pa.array(values, type=kind)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(max(n, 2 * len(_POWERS)), _BASE, np.uint64))
    return _POWERS


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in an array of bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def slices(data: bytes) -> Iterator[bytes]:
    """Cuts a long text at white space, so that no word is cut."""
    at = 0
    while len(data) - at > SLICE:
        end = at + SLICE
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:] if at else data


def word_hashes(data: bytes, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; ``lower`` maps A-Z to a-z first."""
    found = []
    for part in slices(data):
        raw = np.frombuffer(part, np.uint8)
        if lower:
            raw = _LOWER[raw]
        starts, ends = spans(raw)
        if not len(starts):
            continue
        lengths = ends - starts
        table = powers(int(lengths.max()))
        inner = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        letters = raw[np.repeat(starts, lengths) + inner].astype(np.uint64) + np.uint64(1)
        sums = np.add.reduceat(letters * table[inner], np.cumsum(lengths) - lengths)
        found.append(mix(sums + lengths.astype(np.uint64)))
    if not found:
        return np.zeros(0, np.uint64)
    return found[0] if len(found) == 1 else np.concatenate(found)


def sequence_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, by doubling."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    held, width, done, out = words, 1, 0, None
    mask = (1 << 64) - 1
    left = size
    while left:
        if left & 1:
            n = len(words) - size + 1
            part = held[done:done + n] * np.uint64(pow(_STEP, done, 1 << 64) & mask)
            out = part if out is None else out + part
            done += width
        left >>= 1
        if left:
            held = held[:len(held) - width] + held[width:] * np.uint64(pow(_STEP, width, 1 << 64))
            width *= 2
    return mix(out)


def word_bytes(text: str) -> list[bytes]:
    """The words themselves; bytes.split() splits at ASCII white space only."""
    return text.encode("utf-8").split()

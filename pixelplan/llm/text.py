"""Vectorised helpers on UTF-8 buffers, shared by the text operators.

All of them work on Arrow batches inside Spark tasks; a batch is cut into slices of half a MB, so that
the temporary arrays stay small however many rows Spark hands over at once.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

#: Bytes of text and rows that one slice holds (a single longer row is a slice of its own).
SLICE_BYTES = 1 << 19
SLICE_ROWS = 4096
#: Bytes whose words are hashed at once, and powers that a worker keeps.
HASHED_BYTES = 1 << 17
POWERS_KEPT = 1 << 20

#: Upper-case ASCII becomes lower-case; every ASCII byte that is no letter or digit becomes a blank.
WORD_TABLE = np.full(256, 32, np.uint8)
WORD_TABLE[0x80:] = np.arange(0x80, 0x100)
WORD_TABLE[0x30:0x3A] = np.arange(0x30, 0x3A)
WORD_TABLE[0x61:0x7B] = np.arange(0x61, 0x7B)
WORD_TABLE[0x41:0x5B] = np.arange(0x61, 0x7B)

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and those of its inverse; a worker keeps those for usual slices only."""
    if len(_powers.get("up", ())) >= n:
        return _powers["up"][:n], _powers["down"][:n]
    made = {}
    for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
        row = np.full(1 << max(16, (n - 1).bit_length()) if n <= POWERS_KEPT else n, base, np.uint64)
        row[0] = 1
        made[name] = np.multiply.accumulate(row)
    if n <= POWERS_KEPT:
        _powers.update(made)
    return made["up"][:n], made["down"][:n]


class Rolling:
    """Hashes of any spans of one buffer that depend on the span's bytes only."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, width: int) -> np.ndarray:
        """The hash of each span of this width."""
        n = max(0, len(self.sums) - width)
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row begins (one more for the end). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def release() -> None:
    """Gives free memory back to the system: an executor keeps several workers alive between tasks, whose leftovers add up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most this many bytes of text and rows, at least one row each; at the end free memory is released."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        ends, begin = np.cumsum(size), 0
        while begin < batch.num_rows:
            had = ends[begin - 1] if begin else 0
            end = min(max(begin + 1, int(np.searchsorted(ends, had + most, "right"))), begin + rows)
            yield batch.slice(begin, end - begin)
            begin = end
    batch = None
    release()


def word_spans(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; start and end of each word; each row's first word (one more for the end).

    A word is a longest run of ASCII letters, digits and non-ASCII bytes within one row.
    """
    low = WORD_TABLE[data]
    inside = np.zeros(len(low) + 2, np.bool_)
    inside[1:-1] = low != 32
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    edges = rows[(rows > 0) & (rows < len(low))]
    begins[edges] = inside[edges + 1]
    stops[edges - 1] = inside[edges]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return low, start, end, np.searchsorted(start, rows)


def word_hashes(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and each row's first word (one more for the end)."""
    low, start, end, first = word_spans(data, rows)
    out, k = np.empty(len(start), np.uint64), 0
    while k < len(start):  # some words at a time, so that the sums stay small
        stop = max(k + 1, int(np.searchsorted(end, start[k] + HASHED_BYTES, "right")))
        at = start[k]
        out[k:stop] = Rolling(low[at : end[stop - 1]]).spans(start[k:stop] - at, end[k:stop] - at)
        k = stop
    return out, first


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of so many words; runs across rows are for the caller to leave out."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix(out + np.uint64(size))


def expand(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of so many numbers from each start: which range each number is of, and the numbers."""
    which = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    return which, starts[which] + within


def packed(df: DataFrame, column: str) -> DataFrame:
    """df with a column of strings as zstd frames of their UTF-8 bytes: they take two thirds of the room in a shuffle."""
    kinds = ", ".join(f"`{f.name}` {'binary' if f.name == column else f.dataType.simpleString()}" for f in df.schema.fields)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, column):
            frames = [None if x is None else tool.compress(x) for x in batch[column].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary()) if name == column else batch[name] for name in batch.schema.names], batch.schema.names)

    return df.mapInArrow(pack, kinds)


def unpacked(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same batches with that column as bytes again, some MB at a time. Null counts as empty."""
    tool = zstandard.ZstdDecompressor()
    for batch in slices(batches, column, SLICE_BYTES // 4):
        texts = [b"" if x is None else tool.decompress(x) for x in batch[column].to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()) if name == column else batch[name] for name in batch.schema.names], batch.schema.names)

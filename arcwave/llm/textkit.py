"""Vectorised word and shingle hashing for Arrow batches of text.

Words are the runs of ``[^\\x20\\x09-\\x0D]`` after A-Z are lower-cased. Everything works on
the UTF-8 bytes of many texts at once, so a task never builds a Python string per word.
A null text has no words, as has an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
STEP = U64(0xC2B2AE3D27D4EB4F | 1)
CHUNK_BYTES = 1 << 20
SLICE_ROWS = 1_024

_BYTES = np.arange(256, dtype=np.uint16)
SEPARATOR = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES)
_VALUE = np.where(SEPARATOR, 0, LOWER + 1).astype(np.uint64)
_powers = np.ones(1, dtype=np.uint64)


def row_name(id_col: str, text_col: str) -> Column:
    """128 bits of the SHA-256 of a row's id and text: equal for rows that repeat both, nulls told from empty values."""
    one = F.col(id_col).cast("string")
    both = F.concat(F.coalesce(F.concat(F.length(one).cast("string"), F.lit(":"), one), F.lit("-")), F.coalesce(F.concat(F.lit("+"), F.col(text_col).cast("string")), F.lit("-")))
    return F.substring(F.unhex(F.sha2(both, 256)), 1, 16)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 2 * len(_powers)), BASE, np.uint64)]))
    return _powers


def slices(batches: Iterator[pa.RecordBatch], place: int, limit: int = CHUNK_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in runs whose text column ``place`` holds about ``limit`` bytes, at most ``rows`` each, without a copy; a longer text stands alone.

    What a task makes of a batch is held by it and, beside its heap, by the JVM; so it follows the run and not Spark's 10,000 rows. What the
    task's memory pool holds is given back when the batches end, as Python workers live on.
    """
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(place)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < b.num_rows:
            end = max(first + 1, int(np.searchsorted(ends, limit + (ends[first - 1] if first else 0), side="right")))
            end = min(end, first + rows)
            yield b.slice(first, end - first)
            first = end
    pa.default_memory_pool().release_unused()


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows that hold about ``limit`` bytes together; a longer text stands alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(off, off[first] + limit, side="right")) - 1)
        yield first, end, buf[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (one more entry at the end)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    sep = SEPARATOR[buf]
    before = np.empty(len(buf), bool)
    before[0] = True
    before[1:] = sep[:-1]
    inner = off[:-1][off[:-1] < len(buf)]
    before[inner] = True
    begins = before & ~sep
    after = np.empty(len(buf), bool)
    after[-1] = True
    after[:-1] = sep[1:]
    after[inner[inner > 0] - 1] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(after & ~sep) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_starts(size: int, starts: np.ndarray) -> np.ndarray:
    """For each byte the start of the word that it is in or behind (0 before the first)."""
    lead = np.zeros(size, np.int64)
    lead[starts] = starts
    return np.maximum.accumulate(lead, out=lead)


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, byte starts, byte ends of all lower-cased words, and each text's first word."""
    starts, ends, first = word_spans(buf, off)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, first
    value = _VALUE[buf]
    longest = int((ends - starts).max())
    place = np.arange(len(buf)) - word_starts(len(buf), starts)
    np.minimum(place, longest, out=place)
    value *= powers(longest + 1)[place]
    return mix(np.add.reduceat(value, starts)), starts, ends, first


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside each text, in order, and each text's first run. A text of 1 to k-1 words has one run: all of it."""
    count = np.diff(first)
    runs = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], runs) + np.repeat(first[:-1], runs)
    span = np.repeat(np.minimum(count, k), runs)
    total = span.astype(np.uint64)
    last = len(words) - 1
    for j in range(k):
        part = words[np.minimum(at + j, last)] if len(at) else np.zeros(0, np.uint64)
        total = total * STEP + np.where(j < span, part, U64(0))
    return mix(total), begin

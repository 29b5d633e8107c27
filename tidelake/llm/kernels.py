"""Vectorised text kernels shared by the operators that read words.

All of them work on the Arrow buffers of a batch of strings: one byte array and
one offset array, so no Python object is made for a word.  A "word" is a maximal
run of bytes other than space and 0x09-0x0D; in UTF-8 this equals the run of
characters, as bytes of a longer sequence are never below 0x80.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of texts in an Arrow batch.
BATCH = 1000
_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MULTIPLIER = _U(0x9E3779B97F4A7C15)


def _byte_codes(lower: bool) -> np.ndarray:
    """A fixed random 64-bit code for each byte; A-Z share the codes of a-z if lower."""
    codes = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
    if lower:
        codes[65:91] = codes[97:123]
    return codes


_CODES = {lower: _byte_codes(lower) for lower in (False, True)}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 18, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of about `most` bytes, and of at most `rows` texts where that is
    given; a longer text is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n, i + (rows or n))
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of the first word of each text and the total)."""
    n = len(offsets) - 1
    inside = ~_SPACE[data]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    begins = first[at]
    begins[0] = True
    begins[1:] |= np.diff(at) > 1
    start = np.flatnonzero(begins)
    length = np.diff(np.append(start, len(at)))
    place = np.arange(len(at)) - np.repeat(start, length)
    powers = np.cumprod(np.full(int(length.max()), _MULTIPLIER, np.uint64))
    h = np.add.reduceat(_CODES[lower][data[at]] * powers[place], start)
    return mix(h), np.searchsorted(at[start], offsets)


def shingles(h: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of `width` words, repeats included.

    A text with fewer words, but at least one, has its whole sequence as its only run."""
    n = len(bounds) - 1
    count = np.diff(bounds)
    owner = np.repeat(np.arange(n), count)
    if len(h) >= width:
        total = len(h) - width + 1
        run = np.zeros(total, np.uint64)
        for k in range(width):
            run = run * _MULTIPLIER + h[k : k + total]
        whole = owner[:total] == owner[width - 1 :]
        run, run_owner = mix(run[whole]), owner[:total][whole]
    else:
        run, run_owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        value = np.full(len(short), 0x5851F42D4C957F2D, np.uint64)
        for k in range(width - 1):
            have = count[short] > k
            value[have] = value[have] * _MULTIPLIER + h[bounds[short[have]] + k]
        value = mix(value + count[short].astype(np.uint64))
        run, run_owner = np.concatenate([run, value]), np.concatenate([run_owner, short])
        order = np.argsort(run_owner, kind="stable")
        run, run_owner = run[order], run_owner[order]
    return run, run_owner


def distinct(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) without repeats in a text; ordered by text, then hash."""
    if not len(h):
        return h, owner
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new]


def small_batches(df: DataFrame) -> None:
    """Have the session of `df` send at most `BATCH` rows at once to Python, unless it was given
    a number of its own: a task holds a batch of texts twice, outside the JVM's heap and in the worker."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":  # Spark's own
        conf.set(key, str(BATCH))


def tidy() -> None:
    """Give memory that a task no longer uses back to the system, as workers live on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass

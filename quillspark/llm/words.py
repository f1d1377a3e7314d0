"""Words of UTF-8 texts as 64-bit numbers, many texts at a time.

A word is a run of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased.  The number of a word is a
polynomial over random byte values, so all words of a block come from one cumulative sum.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18  # bytes of text held as 64-bit values at a time
SPAN = 4 << 20  # bytes of text whose words are held at a time

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOLID = np.ones(256, dtype=bool)
_SOLID[[32, *range(9, 14)]] = False
_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_ODD = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, at least n of them."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, BLOCK), base, dtype=np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _powers[base] = np.cumprod(steps)
    return _powers[base]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column, without a copy; a null counts as an empty text."""
    pa.default_memory_pool().release_unused()  # of the batches before
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32) if offsets else np.zeros(1, np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def release() -> None:
    """Give memory that this process holds unused back to the system, as far as its allocators know how."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run``, which leaves no unused memory in its worker: that outlives the task, while others need the memory."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidied


def spans(offsets: np.ndarray, limit: int = SPAN) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer row comes alone."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(rows, max(stop, start + 1))
        yield start, stop
        start = stop


def _block(data: np.ndarray, breaks: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers, begins and ends of a block; a word ends at each of ``breaks`` too."""
    low = _LOWER[data] if lower else data
    solid = _SOLID[low]
    before = np.empty(len(low), dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    before[breaks] = False
    after = np.empty(len(low), dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[breaks[breaks > 0] - 1] = False
    begin = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    sums = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[low] * _power(_BASE, len(low))[: len(low)], out=sums[1:])
    inverse = _power(pow(_BASE, -1, 2**64), len(low))
    return mix((sums[end] - sums[begin]) * inverse[begin]), begin, end


def word_numbers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of the rows, and per row the index of its first word (one more at the end)."""
    return word_places(data, offsets)[:2]


def word_places(
    data: np.ndarray, offsets: np.ndarray, lower: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_numbers``, and where each word begins and ends in ``data``."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    none = np.zeros(0, np.int64)
    numbers, begins, ends, at = [np.zeros(0, np.uint64)], [none], [none], lo
    while at < hi:
        stop = min(hi, at + BLOCK)
        if stop < hi:
            gaps = np.flatnonzero(~_SOLID[data[at:stop]])
            row = int(offsets[np.searchsorted(offsets, stop, side="right") - 1])
            if row > at:
                stop = row
            elif len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:  # one word longer than a block
                row_end = int(offsets[np.searchsorted(offsets, at, side="right")])
                ends_at = np.flatnonzero(~_SOLID[data[stop:row_end]])
                stop = stop + int(ends_at[0]) if len(ends_at) else row_end
        breaks = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop)] - at
        h, begin, end = _block(data[at:stop], breaks, lower)
        numbers.append(h)
        begins.append(begin + at)
        ends.append(end + at)
        at = stop
    begins = np.concatenate(begins)
    return np.concatenate(numbers), np.searchsorted(begins, offsets), begins, np.concatenate(ends)


def sequences(numbers: np.ndarray, k: int) -> np.ndarray:
    """Numbers of all sequences of ``k`` neighbouring words."""
    n = len(numbers) - k + 1
    rolled = numbers[:n] * _ODD[0]
    for j in range(1, k):
        rolled = rolled + numbers[j : n + j] * _ODD[j]
    return mix(rolled + np.uint64(k))


def shingle_sets(numbers: np.ndarray, first: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """Per row its distinct k-word shingles as sorted numbers; fewer words make one, none make none."""
    n = len(numbers)
    rolled = sequences(numbers, k) if n >= k else np.zeros(0, np.uint64)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif b > a:
            short = (numbers[a:b] * _ODD[: b - a]).sum(dtype=np.uint64)
            yield mix(np.array([short + np.uint64(b - a)], dtype=np.uint64))
        else:
            yield np.zeros(0, np.uint64)

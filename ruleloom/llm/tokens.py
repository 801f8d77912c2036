"""Words of many texts as 64-bit hashes, computed on the UTF-8 bytes of an Arrow column by numpy."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package

SLICE = 1 << 19  # bytes worked on at a time; a longer text is a slice of its own
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_rng = np.random.default_rng(20240611)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[ord("A") : ord("Z") + 1] += 32
LOWERED_VALUES = BYTE_VALUES[LOWERED]
SPACE_FREE = ~IS_SPACE


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _odd_inverse(value: int) -> int:
    return pow(value, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i below n at least."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE + 1)
        for name, value in (("up", int(BASE)), ("down", _odd_inverse(int(BASE)))):
            steps = np.full(size, value, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of values[i] * BASE**i; a stretch's hash is a difference of two of them, times the inverse power."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=sums[1:])
    return sums


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some rows (A-Z lowered, between blanks), and the number of words of each row."""
    start, end = int(offsets[0]), int(offsets[-1])
    part = data[start:end]
    if not len(part):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = SPACE_FREE[part]
    bounds = offsets - start
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = np.zeros(len(part) + 1, bool)
    closes[1:-1] = inside[:-1] & ~inside[1:]
    closes[-1] = inside[-1]
    # A word also begins and ends where its row does.
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    opens[heads] = inside[heads]
    tails = bounds[1:][bounds[:-1] < bounds[1:]]
    closes[tails] = inside[tails - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
    hashes = mix(stretch_hashes(prefix_sums(LOWERED_VALUES[part]), starts, ends))
    return hashes, np.diff(np.searchsorted(starts, bounds))


def as_long(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of an array, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]


def as_strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The stretches of the bytes of texts as strings."""
    ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(gathered(data, starts, sizes)))

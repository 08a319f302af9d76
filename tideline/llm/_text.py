"""Words and hashes of whole texts, a slice of an Arrow column at a time, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tideline.llm._shared import MIX_1, mix

#: Bytes of text handled at once; a longer single text is handled alone.
SLICE = 1 << 19
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte, drawn from a fixed seed, plain and with A-Z as a-z.
BYTE_KEYS = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_KEYS = BYTE_KEYS.copy()
LOWER_KEYS[65:91] = BYTE_KEYS[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, np.uint64)
        step[0] = 1
        have = _POWERS[base] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets from 0 of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def cut(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


@dataclass
class Words:
    """Words of some texts: where each starts and ends in buf, the row it belongs to, its 64-bit hash; first: each row's first word."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


def words(buf: np.ndarray, offsets: np.ndarray, lower: bool = False, hashed: bool = True) -> Words:
    """Words [^\\x20\\x09-\\x0D]+ of the texts buf[offsets[i]:offsets[i+1]]."""
    n, rows = len(buf), len(offsets) - 1
    none = np.zeros(0, np.int64)
    if not n:
        return Words(buf, none, none, none, np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64))
    space = IS_SPACE[buf]
    inside = ~space
    begins = inside.copy()
    begins[1:] &= space[:-1]
    at = offsets[:-1][offsets[:-1] < n]
    begins[at] = inside[at]
    start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= space[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    end = np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets).astype(np.int64)
    row = np.repeat(np.arange(rows), np.diff(first))
    if not len(start) or not hashed:
        return Words(buf, start, end, row, np.zeros(0, np.uint64), first)
    return Words(buf, start, end, row, span_hash(buf, start, end, lower), first)


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each buf[start:end]; spans are in order and not empty."""
    length = end - start
    begin = np.cumsum(length) - length
    where = np.arange(int(length.sum())) + np.repeat(start - begin, length)
    pos = where - np.repeat(start, length)
    value = (LOWER_KEYS if lower else BYTE_KEYS)[buf[where]]
    value *= powers(MIX_1, int(length.max()))[pos]
    return mix(np.add.reduceat(value, begin) + length.astype(np.uint64))


class Rolling:
    """Hashes of runs of a sequence of 64-bit values from prefix sums modulo 2 ** 64."""

    def __init__(self, values: np.ndarray, base: int = 0xD6E8FEB86659FD93):
        n = len(values)
        inverse = pow(base, -1, 1 << 64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(base, n), out=self.sums[1:])
        self.inverse = powers(inverse, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hash of values[start:end]."""
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

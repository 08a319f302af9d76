"""Repeated byte strings by a common-prefix interval tree over an enhanced suffix array (operator 10).

A suffix array over a whole corpus has no bounded task. Suffixes are therefore taken at sparse anchors:
the place of the least hash in every stretch of `window - gram + 1` places. Two equal strings of `window`
bytes have an anchor at the same offset, so each repeat is found among the suffixes of one anchor
hash. Those suffixes are sorted with their common prefixes, a stack scan yields the tree of prefix
intervals, and in each interval the left extensions are compared: where they reach `window` together
with the prefix, the interval's members are a repeat group, with all its occurrences. An anchor with
more than `most_contexts` different contexts (or more than `hot` in one block) is decided by hashes of
single runs instead, which are counted with one row for each block at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm import _repeats
from tideline.llm._shared import distinct_columns

GRAM = 32


def sliding(best: np.ufunc, x: np.ndarray, width: int, empty: int) -> np.ndarray:
    """best over x[i:i+width] for each i, in two scans."""
    n = len(x)
    if n < width:
        return x[:0]
    pad = np.full(-n % width, empty, x.dtype)
    rows = np.concatenate([x, pad]).reshape(-1, width)
    before = best.accumulate(rows, axis=1).ravel()
    after = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(after[: n - width + 1], before[width - 1 : n])


def select_least(window: int, gram: int):
    width = window - gram + 1

    def select(block: _repeats.Block) -> np.ndarray:
        n = len(block.values)
        if n < window:
            return np.zeros(0, np.int64)
        at = np.arange(n - gram + 1)
        g = np.maximum(block.rolling.of(at, at + gram), np.uint64(1))
        least = sliding(np.minimum, g, width, 0xFFFFFFFFFFFFFFFF)
        start = at[: len(least)]
        least[start + window > block.bounds[1:][block.row_of[: len(start)]]] = 0
        edge = np.zeros(width - 1, np.uint64)
        return np.flatnonzero(g == sliding(np.maximum, np.concatenate([edge, least, edge]), width, 0))

    return select


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int((x != y).argmax())


def prefix_intervals(prefix: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of each interval of the tree; prefix[i] is shared by the sorted suffixes i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, length in enumerate([*prefix, -1]):
        first = i
        while stack and stack[-1][0] > length:
            most, first = stack.pop()
            yield most, first, i
        if length >= 0 and (not stack or stack[-1][0] < length):
            stack.append((length, first))


def repeats_of(contexts: list[tuple[bytes, int]], window: int) -> Iterator[tuple[int, int, int]]:
    """(member, left, right): the member's bytes at - left .. at + right occur in another member, window bytes at least.

    contexts: bytes around an anchor and the anchor's place in them.
    """
    right = [text[at:] for text, at in contexts]
    left = [text[:at][::-1] for text, at in contexts]
    order = sorted(range(len(contexts)), key=right.__getitem__)
    prefix = [common(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]
    for length, first, last in prefix_intervals(prefix):
        members = sorted(order[first : last + 1], key=left.__getitem__)
        shared = [0, *(common(left[a], left[b]) for a, b in zip(members, members[1:], strict=False)), 0]
        for k, m in enumerate(members):  # a neighbour in the order of left extensions shares the longest
            most = max(shared[k], shared[k + 1])
            if most + length >= window:
                yield m, most, length


def kept_bytes(cut: _repeats.Cut) -> pa.Table:
    b, gone = cut.block, cut.gone
    lost = np.concatenate([[0], np.cumsum(gone)])
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    at = b.offsets[:-1][b.offsets[:-1] < len(gone)]
    begins[at] = gone[at]
    spans = np.concatenate([[0], np.cumsum(begins)])
    left = b.offsets - lost[b.offsets]
    text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(b.ids), [None, pa.py_buffer(left.astype("<i8").tobytes()), pa.py_buffer(b.buf[~gone].tobytes())]).cast(pa.binary())
    return pa.table(
        {
            "doc_id": pa.array(np.asarray(b.ids), pa.int64(), mask=b.null),
            "n_bytes": pa.array(np.diff(b.offsets).astype(np.int64)),
            "n_removed": pa.array((lost[b.offsets[1:]] - lost[b.offsets[:-1]]).astype(np.int64)),
            "n_spans": pa.array((spans[b.offsets[1:]] - spans[b.offsets[:-1]]).astype(np.int64)),
            "kept": text,
            "longest_repeat": pa.array(cut.longest),
        }
    )


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400, gram: int = GRAM, hot: int = 48, most_contexts: int = 1024, least: int = 0) -> DataFrame:
    """Removes each byte covered by a string of `window` bytes that also starts anywhere else.

    Texts are UTF-8; strings never cross documents; overlaps count; all copies go, also the first.
    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary: a cut may fall
    inside a character), longest_repeat (bytes of the longest string that was seen to occur elsewhere
    too, at least: strings are followed up to `window` bytes to either side of an anchor). least: also
    look for shorter strings of at least so many bytes; they count for longest_repeat only, nothing of
    them is removed, and those all of whose anchors are hot are not seen.

    A null text is an empty one; texts shorter than the window are kept; a null id stays null; rows
    with equal ids stay separate rows and count as different documents; an empty table gives an empty
    table; other columns are not read.
    """
    shortest = least or window
    if not 1 <= gram <= shortest <= window:
        raise ValueError("gram must be between 1 and least, and least at most window")
    spec = _repeats.Repeats(window, gram, False, False, select_least(shortest, gram), 2 / (shortest - gram + 2), repeats_of, hot, most_contexts, least)
    return _repeats.find(distinct_columns(docs, id_col, text_col), spec, "suffixes", "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, longest_repeat long", kept_bytes)

"""Token ids of texts from a table of distinct pieces of text, each encoded once by the tokenizer's own library.

A text is cut only where its tokenizer cuts it too, so the ids of the parts are the ids of the text:
- byte-level BPE: before a run of white space that follows something else (its pre-tokens keep
  leading, never trailing, white space); after other Unicode white space no cut is made,
- BPE with word ends (white space is dropped): at ASCII white space and, in words of ASCII and Latin-1
  letters without apostrophes or special strings, between letters, digits and other characters.
  Upper and lower case of A-Z are the same part there.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from tideline.llm import _text

#: Distinct parts that a worker remembers; then it starts anew.
MOST_PARTS = 1_000_000
_KIND = np.full(256, 3, np.uint8)  # 1: letters, 2: digits, 3: other
_KIND[65:91] = _KIND[97:123] = _KIND[0xC3] = 1
_KIND[0x80:0xC0] = 1
_KIND[48:58] = 2
_ODD = np.zeros(256, bool)  # words with these bytes are not divided
_ODD[:33] = _ODD[127] = _ODD[39] = True
_ODD[0xC0:] = True
_ODD[0xC3] = False


def letter_runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row's first part of parts of words, for a tokenizer that drops white space and lower-cases."""
    w = _text.words(buf, offsets, hashed=False)
    n = len(buf)
    if not len(w):
        return w.start, w.end, w.first
    odd = _ODD[buf]
    odd[1:] |= (buf[1:] == 124) & (buf[:-1] == 60)  # <|
    after = (buf[1:] >= 0x80) & (buf[1:] < 0xC0)
    latin = buf[:-1] == 0xC3
    odd[1:] |= after & ~(latin & (buf[1:] != 0x97) & (buf[1:] != 0xB7))
    step = np.zeros(n + 1, np.int8)
    step[w.start] = 1
    step[w.end] -= 1
    inside = np.cumsum(step[:-1]) > 0
    begins = np.zeros(n, bool)
    kind = _KIND[buf]
    begins[1:] = kind[1:] != kind[:-1]
    odd &= inside
    whole = np.add.reduceat(odd.astype(np.int32), w.start) > 0
    fixed = np.zeros(n + 1, np.int8)
    fixed[w.start[whole]] += 1
    np.add.at(fixed, w.end[whole], -1)
    begins &= inside & ~(np.cumsum(fixed[:-1]) > 0)
    begins[w.start] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], n)
    last = np.searchsorted(start, w.end) - 1  # the last part of each word ends with the word
    end[last] = w.end
    return start, end, np.searchsorted(start, offsets)


def space_led(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row's first part of parts [white space][other] that tile the texts."""
    n = len(buf)
    space = _text.IS_SPACE[buf]
    cut = space.copy()
    if n:
        odd = space | ((buf >= 0x1C) & (buf <= 0x1F))
        odd[1:] |= (buf[:-1] == 0xC2) & ((buf[1:] == 0xA0) | (buf[1:] == 0x85))
        odd[2:] |= (buf[:-2] >= 0xE1) & (buf[:-2] <= 0xE3)  # the third byte of a character that may be white space
        cut[1:] &= ~odd[:-1]
        cut[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(cut)
    return start, np.append(start[1:], n), np.searchsorted(start, offsets)


class Pieces:
    """Distinct parts of texts with their token ids, as flat arrays."""

    def __init__(self, path: str, ids: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ids = ids
        self._clear()

    def _clear(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.length = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)
        self.n = 0

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        length = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.array(list(chain.from_iterable(found)), np.uint32) if self.ids else self.pool[:0]
        return length, flat

    def number(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The number of each part in the table; new ones are encoded."""
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if self.n > MOST_PARTS:
            self._clear()
        out = np.full(len(distinct), -1, np.int64)
        for keys, numbers in self.runs:
            at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
            out = np.where(keys[at] == distinct, numbers[at], out)
        new = np.flatnonzero(out < 0)
        if len(new):
            data = buf.tobytes()
            length, flat = self._encode([data[i:j].decode("utf-8", "replace") for i, j in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            numbers = np.arange(self.n, self.n + len(new))
            out[new] = numbers
            self.n += len(new)
            self.length = np.concatenate([self.length, length])
            self.pool = np.concatenate([self.pool, flat])
            run = (distinct[new], numbers)
            while self.runs and len(self.runs[-1][0]) <= 2 * len(run[0]):  # runs of sorted keys, each over twice the next
                keys, old = self.runs.pop()
                keys, old = np.concatenate([keys, run[0]]), np.concatenate([old, run[1]])
                order = np.argsort(keys, kind="stable")
                run = (keys[order], old[order])
            self.runs.append(run)
        return out[inverse]

    def begin(self) -> np.ndarray:
        return np.cumsum(self.length) - self.length


_TABLES: dict[tuple[str, bool], Pieces] = {}


def table(path: str, ids: bool) -> Pieces:
    """One table for each worker process and tokenizer."""
    if (path, ids) not in _TABLES:
        _TABLES[path, ids] = Pieces(path, ids)
    return _TABLES[path, ids]

"""Substring dedup on words by difference-cover anchors (operator 1).

A difference cover D modulo p holds, for any two places i and j, an offset d < p with (i + d) mod p
and (j + d) mod p both in D. Hashes of `window - p + 1` words are taken only at places in D: two equal
windows always share one of them at the same offset, and equality is then extended to whole windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import _repeats
from tideline.llm._shared import distinct_columns, small_batches

#: Perfect difference sets, by modulus (every difference occurs once).
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}


def cover_of(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest cover that leaves anchors of a third of the window at least."""
    p = max(p for p in COVERS if p == 1 or window - p + 1 >= window / 3)
    return p, COVERS[p]


def select_by_cover(window: int):
    period, cover = cover_of(window)
    table = np.zeros(period, bool)
    table[list(cover)] = True
    gram = window - period + 1

    def select(block: _repeats.Block) -> np.ndarray:
        unit = np.arange(len(block.values))
        inside = unit - block.bounds[:-1][block.row_of]
        left = block.bounds[1:][block.row_of] - unit
        return np.flatnonzero(table[inside % period] & block.long[block.row_of] & (left >= gram))

    return select, gram, len(cover) / period


def kept_words(cut: _repeats.Cut) -> pa.Table:
    b, w, gone = cut.block, cut.block.words, cut.gone
    n = len(b.ids)
    keep = ~gone
    ends_kept = np.zeros(len(keep), bool)  # the last kept word of its row
    kept = np.flatnonzero(keep)
    if len(kept):
        ends_kept[kept[np.concatenate([w.row[kept][1:] != w.row[kept][:-1], [True]])]] = True
    buf = np.empty(len(b.buf) + 1, np.uint8)
    buf[:-1] = b.buf
    step = np.zeros(len(buf) + 1, np.int8)
    step[w.start[kept]] += 1
    joined = kept[~ends_kept[kept]]  # these take the byte behind them as the space
    buf[w.end[joined]] = 32
    stop = w.end[kept].copy()
    stop[~ends_kept[kept]] += 1
    np.add.at(step, stop, -1)
    mask = np.cumsum(step[:-1], dtype=np.int8) > 0
    before = np.concatenate([[0], np.cumsum(mask)])
    offsets = before[b.offsets]
    n_words = np.diff(w.first)
    lost = np.concatenate([[0], np.cumsum(gone)])
    text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype("<i8").tobytes()), pa.py_buffer(buf[mask].tobytes())).cast(pa.string())
    return pa.table(
        {
            "doc_id": pa.array(np.asarray(b.ids), pa.int64(), mask=b.null),
            "n_words": pa.array(n_words.astype(np.int64)),
            "n_removed": pa.array((lost[w.first[1:]] - lost[w.first[:-1]]).astype(np.int64)),
            "kept_text": text,
        }
    )


def changed_words(cut: _repeats.Cut) -> pa.Table:
    """kept_words, but rows that lose nothing have their text as it was."""
    out, b = kept_words(cut), cut.block
    whole = pa.LargeStringArray.from_buffers(len(b.ids), pa.py_buffer(b.offsets.astype("<i8").tobytes()), pa.py_buffer(b.buf.tobytes())).cast(pa.string())
    text = pc.if_else(pc.greater(out["n_removed"], 0), out["kept_text"], whole)
    return out.set_column(3, "kept_text", text)


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, hot: int = 48) -> DataFrame:
    """Removes each word that is covered by a run of `window` words which also starts earlier.

    Words are [^\\x20\\x09-\\x0D]+, unchanged; earlier means a smaller id, or the same document and an
    earlier start; runs never cross documents and are judged on the input. Returns doc_id, n_words,
    n_removed, kept_text (kept words joined by one space).

    Null or empty texts have no words and keep an empty text; a null id counts as the largest one;
    rows with equal ids stay separate rows, ordered as they are met in a block or by block; texts
    shorter than the window are kept whole; an empty table gives an empty table; other columns are
    not read.
    """
    if window < 1:
        raise ValueError("window must be 1 at least")
    select, gram, density = select_by_cover(window)
    spec = _repeats.Repeats(window, gram, True, True, select, density, hot=hot)
    return _repeats.find(distinct_columns(docs, id_col, text_col), spec, "substrings", "doc_id long, n_words long, n_removed long, kept_text string", kept_words)


def cut_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """docs with the words removed that `remove_repeated_windows` removes, all columns kept.

    A text that loses nothing stays as it is, white space included; another becomes its kept words,
    joined by one space. No row is dropped; cases as in `remove_repeated_windows`.
    """
    if window < 1:
        raise ValueError("window must be 1 at least")
    select, gram, density = select_by_cover(window)
    spec = _repeats.Repeats(window, gram, True, True, select, density)
    fields = [f for f in docs.schema.fields if f.name not in (id_col, text_col)]
    plain = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        *[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(fields)],
        F.col(f"`{text_col}`").isNull().alias("missing"),
    )
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_words long, n_removed long, kept_text string" + "".join(f", c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)) + ", missing boolean"
    out = _repeats.find(plain, spec, "passages", schema, changed_words)
    text = F.when(~F.col("missing"), F.col("kept_text"))
    own = {id_col: F.col("doc_id").cast(docs.schema[id_col].dataType), text_col: text} | {f.name: F.col(f"c{i}") for i, f in enumerate(fields)}
    return out.select(*[own[c].alias(c) for c in docs.columns])

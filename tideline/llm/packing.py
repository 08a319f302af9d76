"""Best-fit packing by sums of squares (operator 4).

Each document goes where the sum over residual gaps of (open sequences with that gap) squared becomes
smallest among the open sequences that hold it, which keeps every gap available for what comes later. Long documents are cut first; only
the last piece of a document is shorter than a sequence, so one short piece a document is placed.
Pieces are dealt by a hash of the document to groups of bounded size that are packed apart; a group
leaves a few sequences open, of thousands.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import _pieces, _text
from tideline.llm._shared import distinct_columns

#: Short pieces packed together, on average.
GROUP = 32_768


def tokenize(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Pieces of at most `size` tokens of every whole text, each document ended by end_id.

    Returns doc_id, row (tells apart rows with equal ids), piece, start, length, ids_crc32 (of
    little-endian unsigned 32-bit ids), and ids if asked for. A null text is an empty one: a piece of
    one token.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _pieces.table(tokenizer, ids=True)
        for batch in batches:
            buf, offsets = _text.raw(batch.column("text"))
            for i, j in _text.cut(offsets):
                text = buf[offsets[i] : offsets[j]]
                begin, end, first = _pieces.letter_runs(text, offsets[i : j + 1] - offsets[i])
                if len(begin):
                    number = table.number(text, begin, end, _text.span_hash(text, begin, end, lower=True))
                    length = table.length[number]
                    sums = np.concatenate([[0], np.cumsum(length)])
                    flat = table.pool[np.arange(sums[-1]) + np.repeat(table.begin()[number] - sums[:-1], length)]
                    edge = sums[first]
                else:
                    flat, edge = np.zeros(0, np.uint32), np.zeros(j - i + 1, np.int64)
                ids = np.insert(flat, edge[1:], np.uint32(end_id)).astype("<u4")
                edge = edge + np.arange(j - i + 1)
                n = np.diff(edge)
                pieces = -(-n // size)
                row = np.repeat(np.arange(j - i), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * size
                length = np.minimum(n[row] - start, size)
                at = edge[:-1][row] + start
                raw = memoryview(ids.tobytes())
                out = {
                    "doc_id": batch.column("doc_id").slice(i, j - i).take(pa.array(row)),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist(), strict=True)], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(at, at[-1] + length[-1] if len(at) else 0), pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return distinct_columns(docs, id_col, text_col).mapInArrow(go, schema)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each item of 1 .. size tokens, longest first."""
    n = len(lengths)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_with: list[list[int]] = [[] for _ in range(size + 1)]
    count = np.zeros(size + 1, np.int64)
    made = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[k])
        # gap g to g - s: the squares change by 2 * (count[g - s] - count[g]) + 2; a gap of 0 is no open sequence
        change = np.where(count[s:] > 0, 2 * (count[: size + 1 - s] - count[s:]) + 2, np.iinfo(np.int64).max)
        if count[s]:
            change[0] = -2 * count[s] + 1
        best = int(change.argmin()) if s < size else 0
        if change[best] < np.iinfo(np.int64).max:
            gap = s + best
            number = open_with[gap].pop()
            count[gap] -= 1
        else:  # longest first, so a new sequence is opened only where none fits
            gap, number = size, made
            made += 1
        sequence[k], offset[k] = number, size - gap
        if gap > s:
            open_with[gap - s].append(number)
            count[gap - s] += 1
    return sequence, offset


def pack(pieces: DataFrame, size: int = 2048, n_documents: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...).

    Every piece is placed, gapless from offset 0 in its sequence; ids of sequences are any numbers.
    Pieces with equal ids and numbers are different pieces. An empty table stays empty.
    """
    count = pieces.count() if n_documents is None else n_documents
    groups = max(1, -(-count // GROUP))
    columns = pieces.columns

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        sequence, offset = sum_of_squares(pdf["length"].to_numpy(), size)
        pdf["sequence_id"], pdf["offset"] = pdf["_group"].to_numpy() * (1 << 32) + sequence, offset
        return pdf[[*columns, "sequence_id", "offset"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(go, schema)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenizes and packs all documents into sequences of at most `size` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for). Null
    or empty texts are pieces of one token; a null id is packed like any other; repeated rows are
    packed each; an empty table gives an empty table; other columns are not read.
    """
    return pack(tokenize(docs, tokenizer, id_col, text_col, size, end_id, with_ids), size, docs.count())

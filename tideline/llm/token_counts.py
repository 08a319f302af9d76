"""Token counts without ids (operator 5).

Each slice of texts becomes a table of distinct pre-token groups; the tokenizer counts the pieces of
a group once for each worker that meets it, the counts are joined to the groups of each document by
number and summed. No token ids are built into columns and nothing is shuffled: a global table of
distinct pre-tokens would have to be joined to several hundred rows for each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm import _pieces, _text
from tideline.llm._shared import distinct_columns


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Tokens of every whole text as the library for a byte-level BPE .json file gives them.

    tokenizer: the file's path, the same on every worker. Special strings inside texts are one token
    each, as is the library's default; nothing is added, cut or padded. Returns doc_id, n_bytes,
    n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty (0 tokens); a null id stays null; repeated rows are counted row by
    row; an empty table gives an empty table; other columns are not read.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces.table(tokenizer, ids=False)
        for batch in batches:
            buf, offsets = _text.raw(batch.column("text"))
            total = np.zeros(len(offsets) - 1, np.int64)
            for i, j in _text.cut(offsets):
                b, o = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                start, end, first = _pieces.space_led(b, o)
                if len(start):
                    number = pieces.number(b, start, end, _text.span_hash(b, start, end))
                    sums = np.concatenate([[0], np.cumsum(pieces.length[number])])
                    total[i:j] = sums[first[1:]] - sums[first[:-1]]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)), "n_tokens": pa.array(total), "over_limit": pa.array(total > limit)}
            )

    return distinct_columns(docs, id_col, text_col).mapInArrow(go, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

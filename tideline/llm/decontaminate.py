"""Benchmark decontamination by size-partitioned MinHash containment search (operator 3).

A short item inside a long document has a tiny Jaccard similarity, so signatures of both sides say
nothing. Containment needs samples of the smaller set only: an item keeps the shingles that are the
least under each of `samples` hash functions, and a document that holds a share c of the item's
shingles holds each sample with chance c. Items are partitioned by set size; a document probes only
partitions whose items are small enough to be contained in it. Each (document, item) with a sample in
common is then decided by the exact containment of the item's shingle set in the document's.

Items are the query set: they go to every task in blocks of bounded size, one pass over the documents
for each block. The documents are neither shuffled nor joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import _text
from tideline.llm._shared import mix, small_batches, store

#: Bytes of item texts in one block.
ITEM_BYTES = 8 << 20
#: Blocks that one pass over the documents looks up; what it leaves is written before the next pass.
PASS_BLOCKS = 4


def shingles(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word shingles of each text in order, and each text's first; a shorter text is one shingle."""
    w = _text.words(buf, offsets, lower=True)
    n = np.diff(w.first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    start = w.first[:-1][row] + np.arange(len(row)) - first[:-1][row]
    return _text.Rolling(w.hash).of(start, start + np.minimum(size, n[row])), first


@dataclass
class Items:
    """A block of items: ids, their shingle sets, and by size partition the sampled shingles with their items."""

    ids: list[int]
    sets: list[np.ndarray]
    partitions: list[tuple[int, np.ndarray, np.ndarray]]
    marks: np.ndarray

    def matches(self, buf: np.ndarray, offsets: np.ndarray, size: int, percent: int) -> Iterator[tuple[int, int, int]]:
        """(text, item, shared shingles) with 100 * shared >= percent * shingles of the item."""
        h, first = shingles(buf, offsets, size)
        hit = np.flatnonzero(self.marks[(h & np.uint64(len(self.marks) - 1)).astype(np.int64)])
        if not len(hit):
            return
        row = np.searchsorted(first, hit, side="right") - 1
        found = []
        for least, keys, items in self.partitions:
            fits = hit[100 * np.diff(first)[row] >= percent * least]
            lo, hi = np.searchsorted(keys, h[fits]), np.searchsorted(keys, h[fits], side="right")
            n = hi - lo
            at = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.stack([np.repeat(np.searchsorted(first, fits, side="right") - 1, n), items[at]], axis=1))
        own, last = None, -1
        for r, item in np.unique(np.concatenate(found), axis=0).tolist():
            if r != last:
                own, last = np.unique(h[first[r] : first[r + 1]]), r
            wanted = self.sets[item]
            at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
            shared = int((own[at] == wanted).sum())
            if 100 * shared >= percent * len(wanted):
                yield r, item, shared


def index(ids: list[int], texts: pa.Array, size: int, samples: int) -> Items:
    buf, offsets = _text.raw(texts)
    h, first = shingles(buf, offsets, size)
    sets = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    rng = np.random.Generator(np.random.PCG64(3))
    keys = rng.integers(0, 1 << 63, samples, dtype=np.uint64)
    by_size: dict[int, list[tuple[int, int]]] = {}
    for item, s in enumerate(sets):
        if len(s):
            chosen = {int(s[mix(s ^ k).argmin()]) for k in keys}
            by_size.setdefault(len(s).bit_length() - 1, []).extend((x, item) for x in chosen)
    partitions = []
    for c, rows in sorted(by_size.items()):
        rows.sort()
        partitions.append((1 << c, np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)))
    total = sum(len(p[1]) for p in partitions)
    marks = np.zeros(1 << max(16, math.ceil(math.log2(max(1, 32 * total)))), bool)
    for _, found, _ in partitions:
        marks[(found & np.uint64(len(marks) - 1)).astype(np.int64)] = True
    return Items(ids, sets, partitions, marks)


def item_blocks(items: DataFrame, id_col: str, text_col: str, size: int, samples: int) -> Iterator[Items]:
    """Items in blocks; null texts and texts without words can't be contained and are left out."""
    rows = items.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // ITEM_BYTES))
    for k in range(blocks):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        yield index(got["item_id"].to_pylist(), got["text"], size, samples)


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", size: int = 5, percent: int = 80, samples: int = 16) -> DataFrame:
    """Pairs of documents and benchmark items that they contain.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; an item is contained if at least percent of
    its distinct shingles of `size` words occur in the document. With 16 samples, a contained item
    is missed once in 10 ** 11. Returns doc_id, item_id, n_shared, n_item, containment.

    Null or empty texts contain nothing and are contained nowhere; a text with fewer words than `size`
    is one shingle; null ids stay null; repeated rows give repeated pairs; empty tables give no
    pairs; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = None
    for block in item_blocks(items, item_id_col, item_text_col, size, samples):
        sent = spark.sparkContext.broadcast(block)

        def go(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            b = sent.value
            for batch in batches:
                rows = [(i + r, b.ids[item], shared, len(b.sets[item])) for i, buf, offsets in text_slices(batch, "text") for r, item, shared in b.matches(buf, offsets, size, percent)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())),
                        "item_id": pa.array([r[1] for r in rows], pa.int64()),
                        "n_shared": pa.array([r[2] for r in rows], pa.int64()),
                        "n_item": pa.array([r[3] for r in rows], pa.int64()),
                        "containment": pa.array([r[2] / r[3] for r in rows], pa.float64()),
                    }
                )

        found = source.mapInArrow(go, "doc_id long, item_id long, n_shared long, n_item long, containment double")
        out = found if out is None else out.union(found)
    return out


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    buf, offsets = _text.raw(batch.column(column))
    for i, j in _text.cut(offsets):
        yield i, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", size: int = 5, percent: int = 80, samples: int = 16) -> DataFrame:
    """docs without the rows that contain an item, all columns kept; cases as in `contained`."""
    small_batches(docs.sparkSession)
    spark, schema, place = docs.sparkSession, docs.schema, docs.columns.index(text_col)
    in_pass = []
    for block in item_blocks(items, item_id_col, item_text_col, size, samples):
        if len(in_pass) == PASS_BLOCKS:
            docs = store(docs, "clean")
            for old in in_pass:
                old.unpersist()
            in_pass = []
        sent = spark.sparkContext.broadcast(block)
        in_pass.append(sent)

        def go(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                buf, offsets = _text.raw(batch.column(place))
                for i, j in _text.cut(offsets):
                    for r, _, _ in sent.value.matches(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size, percent):
                        keep[i + r] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(go, schema)
    return docs

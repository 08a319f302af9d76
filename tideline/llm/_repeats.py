"""Runs of `window` units (words or bytes) that occur more than once anywhere in a corpus.

Documents are packed into blocks of about half a megabyte, written once (rows of over half a megabyte
are costly for the JVM). Four passes follow, each over
blocks or buckets of bounded size:

1. each block hashes its anchors (sparse places that two equal runs always share) with the context
   of all runs through that anchor; equal contexts in a block are sent once,
2. buckets by anchor hash find anchors that occur again: anchors with equal contexts are decided
   there (every run through them is equal); those with several contexts are only marked,
3. marked blocks send what is needed to decide the rest: hashes of single runs, or context bytes,
4. each block puts together what was decided and cuts its documents.

An anchor reaches a bucket at most `hot` times per block, a hot anchor and a hot run once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import _text
from tideline.llm._shared import MIX_1, MOST_PARTITIONS, blobs_by_bucket, columns_of_blobs, expand, mix, per_bucket, squeeze, store

BLOCK_BYTES = 1 << 19
BUCKET_ROWS = 500_000
DECIDED, SUFFIXES, RUNS = 1, 2, 4
_SIGN = np.uint64(1 << 63)
BLOCKS = "block long, n_docs int, n_bytes long, body binary, carried binary"


@dataclass(frozen=True)
class Repeats:
    """What to look for. gram: units of an anchor; by_word: units are words, else bytes; keep_first: the earliest stays.

    hot: different contexts of one anchor in one block beyond which the anchor counts as hot.
    most_contexts: different contexts of one anchor that are compared as suffixes; beyond it single runs are hashed.
    least: units from which on a shorter repeat is reported too (found at anchors that are not hot); the window if 0.
    """

    window: int
    gram: int
    by_word: bool
    keep_first: bool
    select: Callable[[Block], np.ndarray]
    density: float
    contexts: Callable[[Iterator[tuple]], Iterator[tuple]] | None = None
    hot: int = 48
    most_contexts: int = 1024
    least: int = 0

    @property
    def shortest(self) -> int:
        return self.least or self.window


class Block:
    """One block: ids, bytes and units with their hashes. bounds: the first unit of each row."""

    def __init__(self, body: bytes, spec: Repeats):
        data = expand(body)
        n = int(np.frombuffer(data, "<i8", 1)[0])
        self.ids = np.frombuffer(data, "<i8", n, 8)
        self.null = np.frombuffer(data, np.uint8, n, 8 + 8 * n).astype(bool)
        self.offsets = np.frombuffer(data, "<i8", n + 1, 8 + 9 * n)
        self.buf = np.frombuffer(data, np.uint8, -1, 8 + 9 * n + 8 * (n + 1))
        self.spec = spec
        if spec.by_word:
            self.words = _text.words(self.buf, self.offsets)
            self.values, self.bounds = self.words.hash, self.words.first
        else:
            self.values, self.bounds = _text.BYTE_KEYS[self.buf], self.offsets
        self.rolling = _text.Rolling(self.values)
        long = np.diff(self.bounds) >= spec.shortest
        self.row_of = np.repeat(np.arange(n), np.diff(self.bounds))
        self.long = long

    def order(self, rows: np.ndarray) -> np.ndarray:
        """A key that sorts as doc_id does; null last."""
        key = self.ids.astype(np.int64).view(np.uint64) ^ _SIGN
        key = np.where(self.null, np.uint64(0xFFFFFFFFFFFFFFFF), key)
        return key[rows]

    def anchors(self) -> None:
        """Anchors: at, lo..hi (the runs through each begin there; none in a shorter row), hash, context lo..end, and the first of each context."""
        s = self.spec
        self.at = s.select(self)
        row = self.row_of[self.at]
        self.lo = np.maximum(self.at - (s.window - s.gram), self.bounds[row])
        self.end = np.minimum(self.at + s.window, self.bounds[row + 1])
        self.hi = np.maximum(self.end - s.window, self.lo - 1)
        self.runs_there = self.end - self.lo >= s.window
        self.anchor_row = row
        self.h = self.rolling.of(self.at, self.at + s.gram)
        self.ctx = mix(self.rolling.of(self.lo, self.end) + (self.at - self.lo).astype(np.uint64) * np.uint64(MIX_1))
        _, first, self.kind, self.copies = np.unique(self.ctx, return_index=True, return_inverse=True, return_counts=True)
        self.first = first
        _, inverse, count = np.unique(self.h[first], return_inverse=True, return_counts=True)
        self.hot = np.zeros(len(self.at), bool)
        self.hot[first[count[inverse] > s.hot]] = True

    def decided(self, marks: np.ndarray) -> np.ndarray:
        """Which anchors' contexts, and so all runs in them, are repeats. marks: anchor * 8 + bits."""
        if self.spec.keep_first:
            out = np.ones(len(self.at), bool)
            out[self.first] = False
        else:
            out = self.copies[self.kind] > 1
        hit = (marks[(marks & DECIDED) > 0] >> 3).astype(np.int64)
        if self.spec.keep_first:
            out[hit] = True
        else:
            by_kind = np.zeros(len(self.copies), bool)
            by_kind[self.kind[hit]] = True
            out |= by_kind[self.kind]
        return out

    def runs(self, marks: np.ndarray, decided: np.ndarray) -> None:
        """Single runs to look up: first place of each different one in the block, its two hashes; repeats inside the block."""
        chosen = self.hot.copy()
        chosen[(marks[(marks & RUNS) > 0] >> 3).astype(np.int64)] = True
        chosen &= self.runs_there
        decided = decided & self.runs_there
        s, n = self.spec, len(self.values)
        want = spread(self.lo[chosen], self.hi[chosen] + 1, n)
        if s.keep_first:  # an earliest run is never decided; without keep_first a decided run may be another's only partner
            want &= ~spread(self.lo[decided], self.hi[decided] + 1, n)
        start = np.flatnonzero(want)
        run = self.rolling.of(start, start + s.window)
        _, first, self.run_kind, copies = np.unique(run, return_index=True, return_inverse=True, return_counts=True)
        self.run_at, self.run_first, self.run_hash = start, first, run
        self.run_again = copies[self.run_kind] > 1
        if s.keep_first:
            self.run_again[first] = False


def spread(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """A mask of n units that is true in lo[i]:hi[i] for any i."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, lo, 1)
    np.add.at(step, hi, -1)
    return np.cumsum(step[:-1]) > 0


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, ...) to blocks, sorted by doc_id inside a block; further columns are carried along."""
    part, number = TaskContext.get().partitionId(), 0
    held: list[pa.RecordBatch] = []
    size = 0

    def block() -> pa.RecordBatch:
        nonlocal number
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table["doc_id"].combine_chunks() if isinstance(table["doc_id"], pa.ChunkedArray) else table["doc_id"]
        null = np.asarray(ids.is_null())
        plain = np.asarray(ids.fill_null(0), dtype=np.int64)
        order = np.lexsort((plain, null))
        buf, offsets = _text.raw(table["text"].take(pa.array(order)))
        raw = np.int64(len(order)).tobytes() + plain[order].tobytes() + null[order].astype(np.uint8).tobytes() + offsets.astype("<i8").tobytes() + buf.tobytes()
        number += 1
        carried = table.drop_columns(["doc_id", "text"])
        if carried.num_columns:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, carried.schema) as out:
                out.write_table(carried.take(pa.array(order)))
            carried = squeeze(sink.getvalue(), 3)
        else:
            carried = None
        return pa.RecordBatch.from_pydict({"block": pa.array([(part << 33) + number - 1], pa.int64()), "n_docs": pa.array([len(order)], pa.int32()), "n_bytes": pa.array([len(buf)], pa.int64()), "body": pa.array([squeeze(raw, 3)], pa.binary()), "carried": pa.array([carried], pa.binary())})

    for batch in batches:
        _, offsets = _text.raw(batch.column("text"))
        for i, j in _text.cut(offsets, BLOCK_BYTES // 4):
            held.append(batch.slice(i, j - i))
            size += int(offsets[j] - offsets[i])
            if size >= BLOCK_BYTES:
                yield block()
                held, size = [], 0
    if held:
        yield block()


def blocks(docs: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The stored blocks of (doc_id, text) and their bytes of text."""
    out = store(docs.mapInArrow(pack, BLOCKS), name, "uncompressed")
    return out, out.agg(F.sum("n_bytes")).first()[0] or 0


def _flush(entries: list[tuple], n_buckets: int, keys: tuple[int, ...]) -> Iterator[tuple[int, bytes]]:
    """Entries (hash, columns...) to one blob for each bucket."""
    return blobs_by_bucket([np.concatenate(c) for c in zip(*entries, strict=True)], n_buckets, keys)


ANCHOR_KEYS = (6, 5, -8, -8, -8, 1)  # hash, context, document's order, block, anchor, hot
RUN_KEYS = (8, 5, -8, -8, -8)  # hash, second hash, document's order, block, run's start


def _anchor_rows(spec: Repeats, n_buckets: int) -> Callable:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            for bucket, blob in _flush(held, n_buckets, ANCHOR_KEYS):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64()), "blob": pa.array([blob], pa.binary())})

        for batch in batches:
            for number, body in zip(batch.column("block").to_pylist(), batch.column("body"), strict=True):
                b = Block(body.as_buffer(), spec)
                b.anchors()
                if not len(b.at):
                    continue
                send = np.sort(b.first[~b.hot[b.first]])
                hot = np.flatnonzero(b.hot)
                _, one = np.unique(b.h[hot], return_index=True)
                at = np.concatenate([send, hot[one]])
                held.append((b.h[at], b.ctx[at], b.order(b.anchor_row[at]), np.full(len(at), number, np.uint64), at.astype(np.uint64), b.hot[at].astype(np.uint64)))
                count += len(at)
                if count >= 1_000_000:
                    yield from out()
                    held, count = [], 0
        if held:
            yield from out()

    return go


def _by_block(block: np.ndarray, value: np.ndarray, kind: int) -> pa.Table:
    order = np.argsort(block, kind="stable")
    block, value = block[order], value[order]
    edge = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]) if len(block) else np.zeros(1, np.int64)
    return pa.table(
        {
            "block": pa.array(block[edge[:-1]].astype(np.int64), pa.int64()),
            "kind": pa.array(np.full(len(edge) - 1, kind, np.int32), pa.int32()),
            "blob": pa.array([squeeze(value[i:j].astype("<u8").tobytes()) for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary()),
        }
    )


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Number of the group of each row; rows are sorted by the keys."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _match_anchors(spec: Repeats) -> Callable:
    def go(table: pa.Table) -> pa.Table:
        h, ctx, doc, block, at, hot = columns_of_blobs(table["blob"].to_pylist(), ANCHOR_KEYS)
        order = np.argsort(h, kind="stable")
        count = np.bincount(_groups(h[order])) if len(h) else np.zeros(0, np.int64)
        order = order[np.repeat(count > 1, count)]
        order = order[np.lexsort((at[order], block[order], doc[order], ctx[order], h[order]))]
        h, ctx, block, at, hot = h[order], ctx[order], block[order], at[order], hot[order] > 0
        if not len(h):
            return _by_block(block, at, 0)
        anchor, kind = _groups(h), _groups(h, ctx)
        first = np.concatenate([[True], np.diff(kind) > 0])
        members = np.bincount(kind)[kind]
        kinds = np.bincount(anchor[first])[anchor]
        is_hot = np.bincount(anchor, hot)[anchor] > 0
        bits = np.where((~first) if spec.keep_first else (members > 1), DECIDED, 0)
        single = is_hot | (kinds > spec.most_contexts) | (spec.contexts is None)
        bits |= np.where(first & ((kinds > 1) | is_hot), np.where(single, RUNS, SUFFIXES), 0)
        bits = np.where(hot, bits & DECIDED, bits)  # its block sends all runs of a hot anchor unasked
        keep = bits > 0
        return _by_block(block[keep], at[keep] * np.uint64(8) + bits[keep].astype(np.uint64), 0)

    return go


MARKS = "block long, kind int, blob binary"


def _of_kind(marks: list[tuple[int, bytes]], kind: int) -> np.ndarray:
    blobs = [b for k, b in marks if k == kind]
    return np.concatenate([np.frombuffer(expand(b), "<u8") for b in blobs]) if blobs else np.zeros(0, np.uint64)


Marks = list[tuple[int, bytes]]
#: Bytes of text in the blocks of one partition.
PART_BYTES = 16 << 20


def _per_block(stored: DataFrame, size: int, marks: DataFrame, function: Callable[[int, bytes, bytes | None, Marks], Iterator[pa.Table]], schema: str, carried: bool = False) -> DataFrame:
    """function(number, body, carried, marks) for every block, in one exchange of blocks and marks.

    Partitions hold some dozen blocks, whose bodies (compressed) wait in the worker until all marks are
    there; beyond MOST_PARTITIONS such partitions, their rows are sorted and blocks handled one by one.
    """
    parts = max(12, min(MOST_PARTITIONS, size // PART_BYTES))
    ordered = size > 2 * parts * PART_BYTES
    left = stored.select("block", "body", "carried" if carried else F.lit(None).cast("binary").alias("carried"), F.lit(-1).alias("kind"), F.lit(None).cast("binary").alias("blob"))
    right = marks.select("block", F.lit(None).cast("binary").alias("body"), F.lit(None).cast("binary").alias("carried"), "kind", "blob")
    dealt = left.union(right).repartitionById(parts, F.pmod(F.hash("block"), F.lit(parts)))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies: dict[int, tuple] = {}
        found: dict[int, Marks] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for number in list(bodies):
                body, more = bodies.pop(number)
                for table in function(number, body, more, found.pop(number, [])):
                    yield from table.to_batches()

        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for number, body, more, kind, blob in zip(columns[0].to_pylist(), columns[1], columns[2], columns[3].to_pylist(), columns[4], strict=True):
                if ordered and bodies and number not in bodies:
                    yield from out()
                if kind < 0:
                    bodies[number] = body.as_py(), more.as_py()
                else:
                    found.setdefault(number, []).append((kind, blob.as_py()))
        yield from out()

    return (dealt.sortWithinPartitions("block", "kind") if ordered else dealt).mapInArrow(go, schema)


DETAIL = "bucket long, blob binary"


def _detail_rows(spec: Repeats, n_buckets: int) -> Callable:
    """Rows of even bucket numbers are of runs, of odd ones of contexts."""

    def go(number: int, body: bytes, carried: bytes | None, marked: Marks) -> Iterator[pa.Table]:
        b = Block(body, spec)
        b.anchors()
        if not len(b.at):
            return
        rows: list[tuple[int, bytes]] = []
        marks = _of_kind(marked, 0)
        b.runs(marks, b.decided(marks))
        at = np.sort(b.run_first)
        if len(at):
            start = b.run_at[at]
            second = _text.Rolling(b.values, 0xA0761D6478BD642F).of(start, start + spec.window)
            rows += [(2 * k, blob) for k, blob in _flush([(b.run_hash[at], second, b.order(b.row_of[start]), np.full(len(at), number, np.uint64), start.astype(np.uint64))], n_buckets, RUN_KEYS)]
        chosen = (marks[(marks & SUFFIXES) > 0] >> 3).astype(np.int64)
        if len(chosen):
            bucket = (b.h[chosen] >> np.uint64(40)) % np.uint64(n_buckets)
            order = np.argsort(bucket, kind="stable")
            for k in np.unique(bucket):
                a = chosen[order[np.searchsorted(bucket[order], k) : np.searchsorted(bucket[order], k, "right")]]
                lo, hi = b.lo[a], b.end[a]
                head = np.stack([b.h[a].astype(np.uint64), lo.astype(np.uint64), b.at[a].astype(np.uint64), hi.astype(np.uint64)])
                text = b"".join(b.buf[i:j].tobytes() for i, j in zip(lo, hi, strict=True))
                rows.append((2 * int(k) + 1, squeeze(np.array([number, len(a)], "<u8").tobytes() + head.tobytes() + text, 3)))
        yield pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    return go


def _match_detail(spec: Repeats) -> Callable:
    def go(table: pa.Table) -> pa.Table:
        blobs = table["blob"].to_pylist()
        if table["bucket"][0].as_py() % 2 == 0:
            h, second, doc, block, at = columns_of_blobs(blobs, RUN_KEYS)
            order = np.lexsort((at, block, doc, second, h))
            group = _groups(h[order], second[order])
            first = np.concatenate([[True], np.diff(group) > 0]) if len(h) else np.zeros(0, bool)
            again = ~first if spec.keep_first else (np.bincount(group)[group] > 1 if len(h) else first)
            return _by_block(block[order][again], at[order][again], RUNS)
        number, place, lo, at, hi, text = [], [], [], [], [], []
        for blob in blobs:
            data = expand(blob)
            n_block, n = (int(x) for x in np.frombuffer(data, "<u8", 2))
            head = np.frombuffer(data, "<u8", 4 * n, 16).reshape(4, n)
            length = (head[3] - head[1]).astype(np.int64)
            begin = 16 + 32 * n + np.cumsum(length) - length
            number.append(np.full(n, n_block, np.uint64))
            place.append(head[0]), lo.append(head[1].astype(np.int64)), at.append(head[2].astype(np.int64)), hi.append(head[3].astype(np.int64))
            text += [data[i : i + m] for i, m in zip(begin.tolist(), length.tolist(), strict=True)]
        number, place, lo, at, hi = (np.concatenate(x) for x in (number, place, lo, at, hi))
        spans_of, spans = [], []
        order = np.argsort(place, kind="stable")
        edge = np.concatenate([[0], np.flatnonzero(np.diff(place[order])) + 1, [len(order)]])
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            members = order[i:j].tolist()
            for m, left, right in spec.contexts([(text[k], int(at[k] - lo[k])) for k in members], spec.shortest):
                k = members[m]
                spans_of.append(number[k])
                spans.append((int(at[k]) - left) << 32 | (int(at[k]) + right))
        return _by_block(np.array(spans_of, np.uint64), np.array(spans, np.uint64), SUFFIXES)

    return go


@dataclass
class Cut:
    """A block's documents, which of its units repeat, and each document's longest repeat of at least `shortest` units that was seen (0: none)."""

    block: Block
    gone: np.ndarray
    longest: np.ndarray


def _finish(spec: Repeats, result: Callable[[Cut], pa.Table]) -> Callable:
    def go(number: int, body: bytes, carried: bytes | None, marked: Marks) -> Iterator[pa.Table]:
        b = Block(body, spec)
        b.anchors()
        marks = _of_kind(marked, 0)
        decided = b.decided(marks)
        n = len(b.values)
        whole = decided & b.runs_there
        gone = spread(b.lo[whole], b.end[whole], n)
        longest = np.zeros(len(b.ids), np.int64)
        np.maximum.at(longest, b.anchor_row[decided], (b.end - b.lo)[decided])
        if len(b.at):
            b.runs(marks, decided)
            again = b.run_again.copy()
            hit = np.searchsorted(b.run_at, _of_kind(marked, RUNS).astype(np.int64))
            if spec.keep_first:
                again[hit] = True
            else:
                by_kind = np.zeros(len(b.run_first), bool)
                by_kind[b.run_kind[hit]] = True
                again |= by_kind[b.run_kind]
            start = b.run_at[again]
            gone |= spread(start, start + spec.window, n)
            np.maximum.at(longest, b.row_of[start], spec.window)
        spans = _of_kind(marked, SUFFIXES)
        begin, stop = (spans >> np.uint64(32)).astype(np.int64), (spans & np.uint64(0xFFFFFFFF)).astype(np.int64)
        np.maximum.at(longest, b.row_of[begin], stop - begin)
        full = stop - begin >= spec.window
        gone |= spread(begin[full], stop[full], n)
        longest[longest < spec.shortest] = 0
        made = result(Cut(b, gone, longest))
        if carried is not None:
            more = pa.ipc.open_stream(expand(carried)).read_all()
            for name, column in zip(more.column_names, more.columns, strict=True):
                made = made.append_column(name, column)
        yield made

    return go


def find(docs: DataFrame, spec: Repeats, name: str, schema: str, result: Callable[[Cut], pa.Table]) -> DataFrame:
    """`result` of every block of docs (doc_id, text, and columns to carry along, named in the schema after those of `result`)."""
    stored, size = blocks(docs, name)
    n_buckets = max(12, int(size / (6.5 if spec.by_word else 1) * spec.density / BUCKET_ROWS))
    sent = stored.select("block", "body").mapInArrow(_anchor_rows(spec, n_buckets), "bucket long, blob binary")
    marks = store(per_bucket(sent, "bucket", n_buckets, _match_anchors(spec), MARKS), name + "-anchors", "uncompressed")
    detail = _per_block(stored, size, marks, _detail_rows(spec, n_buckets), DETAIL)
    more = per_bucket(detail, "bucket", 2 * n_buckets, _match_detail(spec), MARKS)
    marks = marks.union(store(more, name + "-marks", "uncompressed"))
    return _per_block(stored, size, marks, _finish(spec, result), schema, carried=True)

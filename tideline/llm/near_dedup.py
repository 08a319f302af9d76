"""Near-duplicate documents by MinHash bands and odd sketches (operator 8).

1. Each document becomes the set of its distinct word shingles; documents with equal sets form one
   class at once (counted before any shuffle of signatures).
2. MinHash samples of a class are banded. Equal bands make candidates: within a task and then within
   a band, everyone is compared to the band's first class, never all pairs.
3. The samples are also folded into an odd sketch, a bitmap of parities. The popcount of two
   sketches' XOR estimates a high similarity precisely; candidates far below the threshold go.
4. What is left is confirmed on the full sets. Links make components.
5. A class may be linked to another member of its band than the first. So classes that share bands
   (directly or over others) but are still in different components are compared in blocks: every
   class outside the largest component with all others, by sketch first and, where that leaves
   doubt, on the full sets. A block joins what it links at once, so that pairs which are connected
   by then aren't compared, and sends on a spanning forest: fewer links than it has classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import _graph, _text
from tideline.llm._shared import blobs_by_bucket, columns_of_blobs, distinct_columns, hold, mix, per_bucket, store

SKETCH_BITS = 1024
#: Candidates whose estimated similarity is this far below the threshold are not confirmed: over 4 standard errors.
MARGIN = 0.12
#: Ids that may be sent to every task as a filter (8 bytes each); more are joined by a shuffle.
SENT_IDS = 1_000_000
#: Classes, and shingles, on either side of one block of step 5.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
#: Rows of one file of the classes' components (24 bytes each).
FILE_ROWS = 1_000_000
#: Band keys in one bucket.
BUCKET_KEYS = 1_000_000


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (52-bit hashes, sorted) of each text and each text's first."""
    rows = len(offsets) - 1
    w = _text.words(buf, offsets, lower=True)
    n = np.diff(w.first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(rows), count)
    start = w.first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    h = _text.Rolling(w.hash).of(start, start + np.minimum(size, n[row]))
    if rows > 4000:
        raise ValueError("at most 4000 texts at once")
    key = np.unique(row.astype(np.uint64) << np.uint64(52) | h >> np.uint64(12))
    first = np.searchsorted(key, np.arange(rows + 1, dtype=np.uint64) << np.uint64(52)).astype(np.int64)
    return key & np.uint64((1 << 52) - 1), first


def slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, offsets = _text.raw(batch.column("text"))
    for i, j in _text.cut(offsets):
        for k in range(i, j, 4000):
            m = min(k + 4000, j)
            yield k, m, buf[offsets[k] : offsets[m]], offsets[k : m + 1] - offsets[k]


def signatures(shingles: np.ndarray, first: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x bands) and odd sketches (texts x 16 words of 64 bits) of non-empty sets."""
    rng = np.random.Generator(np.random.PCG64(8))
    k = bands * rows
    add, factor = rng.integers(0, 1 << 63, (2, k), dtype=np.uint64)
    factor = factor * np.uint64(2) + np.uint64(1)
    n = len(first) - 1
    sample = np.empty((k, n), np.uint64)
    x = mix(shingles)
    for i in range(k):
        sample[i] = np.minimum.reduceat((x ^ add[i]) * factor[i], first[:-1])
    keys = np.empty((n, bands), np.uint64)
    for b in range(bands):
        h = np.full(n, b + 1, np.uint64)
        for i in range(b * rows, (b + 1) * rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sample[i])
        keys[:, b] = h
    place = (mix(sample + np.arange(k, dtype=np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flips = np.bincount((np.arange(n)[None, :] * SKETCH_BITS + place).ravel(), minlength=n * SKETCH_BITS) & 1
    return keys, np.packbits(flips.astype(np.uint8).reshape(n, SKETCH_BITS), axis=1)


def estimate(a: np.ndarray, b: np.ndarray, samples: int) -> np.ndarray:
    """Similarity from rows of two sketches (bytes); very different ones give about 0."""
    odd = np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int64)
    share = np.minimum(2 * odd / SKETCH_BITS, 0.999999)
    differing = np.log1p(-share) / np.log1p(-2 / SKETCH_BITS)  # elements in one of the two sample sets only
    return 1 - differing / (2 * samples)


def _sketches(column: pa.Array) -> np.ndarray:
    raw, _ = _text.raw(column)
    return raw.reshape(-1, SKETCH_BITS // 8)


def _sign(size: int, bands: int, rows: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in slices(batch):
                sets, first = shingle_sets(buf, offsets, size)
                n = np.diff(first)
                full = np.flatnonzero(n)
                nulls = pa.nulls(j - i, pa.binary())
                out = {"doc_id": batch.column("doc_id").slice(i, j - i), "n_shingles": pa.array(n)}
                k1 = k2 = np.zeros(j - i, np.uint64)
                bands_, sketch = nulls, nulls
                if len(full):
                    edge = np.append(first[full], first[-1])
                    k1, k2 = k1.copy(), k2.copy()
                    k1[full] = np.add.reduceat(mix(sets), edge[:-1])
                    k2[full] = np.add.reduceat(mix(sets * np.uint64(0x9E3779B97F4A7C15)), edge[:-1])
                    keys, bits = signatures(sets, edge, bands, rows)
                    at = np.full(j - i, -1)
                    at[full] = np.arange(len(full))
                    index = pa.array(at, mask=at < 0)
                    bands_ = pa.array([x.tobytes() for x in keys], pa.binary()).take(index)
                    sketch = pa.array([x.tobytes() for x in bits], pa.binary()).take(index)
                out |= {"k1": pa.array(k1.view(np.int64)), "k2": pa.array(k2.view(np.int64)), "bands": bands_, "sketch": sketch}
                yield pa.RecordBatch.from_pydict(out)

    return go


def _stars(key: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row of each key's first class, and the different pairs (that class, another of the key)."""
    order = np.lexsort((rep, key))
    key, rep = key[order], rep[order]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    lead = rep[new][np.cumsum(new) - 1]
    far = lead != rep
    a, b = lead[far], rep[far]
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    other = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    return order[new], a[other], b[other]


FIRST_KEYS, PAIR_KEYS = (-8, 8), (8, 8)  # first ones come sorted by key


def _deal_bands(bands: int, n_buckets: int):
    """Classes to blobs by bucket of the band key: what a task has of a band is one row, its first class; pairs with that class are sent as they are."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, reps, size = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            key, rep = np.concatenate(keys), np.concatenate(reps)
            first, a, b = _stars(key, rep)
            made = [(k, 0, blob) for k, blob in blobs_by_bucket([key[first], rep[first].view(np.uint64)], n_buckets, FIRST_KEYS)]
            a, b = a.view(np.uint64), b.view(np.uint64)
            made += [(k, 1, blob) for k, blob in blobs_by_bucket([a, b], n_buckets, PAIR_KEYS, mix(a + mix(b)))]
            for i in range(0, len(made), 64):
                part = made[i : i + 64]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([x[0] for x in part], pa.int64()), "kind": pa.array([x[1] for x in part], pa.int32()), "blob": pa.array([x[2] for x in part], pa.binary())})

        for batch in batches:
            raw, _ = _text.raw(batch.column("bands"))
            keys.append(raw.view(np.uint64).copy())
            reps.append(np.repeat(np.asarray(batch.column("rep")), bands))
            size += len(keys[-1])
            if size > 4_000_000:
                yield from out()
                keys, reps, size = [], [], 0
        if keys:
            yield from out()

    return go


def _pairs_of_bucket(table: pa.Table) -> pa.Table:
    kind, blobs = table["kind"].to_pylist(), table["blob"].to_pylist()
    key, rep = columns_of_blobs([b for k, b in zip(kind, blobs, strict=True) if k == 0], FIRST_KEYS)
    a, b = columns_of_blobs([b for k, b in zip(kind, blobs, strict=True) if k == 1], PAIR_KEYS)
    _, lead, other = _stars(key, rep.view(np.int64))
    return pa.table({"a": pa.array(np.concatenate([lead, a.view(np.int64)])), "b": pa.array(np.concatenate([other, b.view(np.int64)]))})


def _likely(samples: int, least: float):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = estimate(_sketches(batch.column("sa")), _sketches(batch.column("sb")), samples) >= least
                yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(keep))

    return go


def _sets(size: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in slices(batch):
                sets, first = shingle_sets(buf, offsets, size)
                raw = sets.tobytes()
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(i, j - i), "shingles": pa.array([raw[8 * a : 8 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())})

    return go


def _linked(percent: int):
    """Of candidates (a, b) with both sets: those that are linked, as a forest."""

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(keep, pa.bool_()))

    return lambda batches: _graph.forest(confirmed(batches))


def _sets_of(rows: DataFrame, ids: DataFrame, n: int, size: int) -> DataFrame:
    """doc_id, shingles of the rows with these (at most n) ids; the ids are sent to the rows if they are few, else joined."""
    ids = ids.distinct()
    chosen = rows.join(F.broadcast(ids) if n <= SENT_IDS else ids, "doc_id", "left_semi")
    return chosen.mapInArrow(_sets(size), "doc_id long, shingles binary").distinct()


def _across(samples: int, least: float, percent: int):
    """Links between the x and the y rows of a block that are in different components, as a spanning forest."""

    def go(table: pa.Table) -> pa.Table:
        side = np.asarray(table["side"])
        rep = np.asarray(table["rep"])
        label = np.unique(np.asarray(table["component"]), return_inverse=True)[1]
        sketch = _sketches(table["sketch"])
        raw, offsets = _text.raw(table["shingles"])
        sets, first = raw.view("<u8"), offsets // 8
        size = np.diff(first)
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = [], []
        for i in x.tolist():
            other = y[label[y] != label[i]]
            other = other[100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i])]
            if not len(other):
                continue
            like = estimate(sketch[other], sketch[i][None, :], samples)
            other = other[np.argsort(-like, kind="stable")[: int((like >= least).sum())]]  # the likeliest first
            own, k, step = sets[first[i] : first[i + 1]], 0, 32
            while k < len(other):
                part = other[k : k + step]
                part = part[label[part] != label[i]]
                k, step = k + step, 512
                if not len(part):
                    continue
                n = size[part]
                at = np.repeat(first[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                theirs = sets[at]
                hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
                both = np.add.reduceat(hit.astype(np.int64), np.cumsum(n) - n)
                for j in part[100 * both >= percent * (n + len(own) - both)].tolist():
                    if label[j] != label[i]:
                        a.append(rep[i]), b.append(rep[j])
                        label[label == label[j]] = label[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return go


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = 48, rows: int = 6) -> DataFrame:
    """Components of documents whose shingle sets have 100 * intersection >= percent * union.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; with fewer words than `shingle`, the whole
    sequence is the one shingle. Returns doc_id, n_shingles, component_id (the smallest id reachable,
    itself included), kept (doc_id = component_id). With 48 bands of 6 samples, a pair at a
    similarity of exactly 0.8 is missed once in two million; one at 0.85 once in 5 thousand million.

    Null, empty or white texts have no shingles and are linked with nothing; a null id has a null
    component and is kept; rows with equal ids and texts share a component, all kept or none; texts
    that share an id which is the smallest of both their classes count as one document with two
    texts, linked by either; an empty table gives an empty table; other columns are not read.
    """
    source = distinct_columns(docs, id_col, text_col)
    samples, least = bands * rows, percent / 100 - MARGIN
    signed = store(source.mapInArrow(_sign(shingle, bands, rows), "doc_id long, n_shingles long, k1 long, k2 long, bands binary, sketch binary"), "signatures")
    known = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = hold(known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.min_by(F.struct("bands", "sketch"), "doc_id").alias("s")).select("k1", "k2", "rep", "n", "s.*"))
    sketches = classes.select("rep", "sketch")
    n_classes = classes.count()
    n_buckets = max(12, n_classes * bands // BUCKET_KEYS)
    dealt = classes.select("rep", "bands").mapInArrow(_deal_bands(bands, n_buckets), "bucket long, kind int, blob binary")
    near = hold(per_bucket(dealt, "bucket", n_buckets, _pairs_of_bucket, "a long, b long").distinct())
    scored = near.join(sketches.withColumnsRenamed({"rep": "a", "sketch": "sa"}), "a").join(sketches.withColumnsRenamed({"rep": "b", "sketch": "sb"}), "b")
    likely = hold(scored.select("a", "b", "sa", "sb").mapInArrow(_likely(samples, least), "a long, b long"))
    sets = _sets_of(source, likely.selectExpr("explode(array(a, b)) AS doc_id"), 2 * likely.count(), shingle)
    both = likely.join(sets.withColumnsRenamed({"doc_id": "a", "shingles": "xa"}), "a").join(sets.withColumnsRenamed({"doc_id": "b", "shingles": "xb"}), "b")
    links = store(both.select("a", "b", "xa", "xb").mapInArrow(_linked(percent), "a long, b long"), "links")
    forest = hold(near.mapInArrow(_graph.forest, "a long, b long"))
    found, coarse = _graph.components(links), _graph.components(forest)
    placed = coarse.select(F.col("id").alias("rep"), F.col("component").alias("coarse")).join(found.withColumnRenamed("id", "rep"), "rep", "left")
    members = hold(placed.withColumn("component", F.coalesce("component", "rep")))
    sized = members.join(classes.select("rep", "n"), "rep")
    per = sized.groupBy("coarse", "component").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    # of two classes that share a band, the pair has been looked at
    most = per.groupBy("coarse").agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.max(F.struct("k", "component", "n")).alias("most")).where("k > most.k AND k > 2")
    blocks = lambda k, n: F.greatest(F.ceil(k / BLOCK), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    dealt_to = {"nx": blocks(F.col("k") - F.col("most.k"), F.col("n") - F.col("most.n")), "ny": blocks(F.col("k"), F.col("n")), "own": F.pmod(F.xxhash64("rep"), F.lit(1 << 30))}
    open_ = members.join(most, "coarse").withColumn("x", F.col("component") != F.col("most.component")).withColumns(dealt_to)
    open_ = hold(open_.select("coarse", "rep", "component", "x", "nx", "ny", "own").join(sketches, "rep"))
    n_open = open_.count()
    if n_open:
        deal = open_.join(_sets_of(source, open_.selectExpr("rep AS doc_id"), n_open, shingle), F.col("rep") == F.col("doc_id"))
        cols = ["coarse", "rep", "component", "sketch", "shingles"]
        xs = deal.where("x").select(*cols, F.lit(0).alias("side"), F.expr("own % nx").alias("bx"), F.explode(F.expr("sequence(0L, ny - 1L)")).alias("by"))
        ys = deal.select(*cols, F.lit(1).alias("side"), F.explode(F.expr("sequence(0L, nx - 1L)")).alias("bx"), F.expr("own % ny").alias("by"))
        more = store(xs.union(ys).groupBy("coarse", "bx", "by").applyInArrow(_across(samples, least, percent), "a long, b long"), "more")
        found = _graph.components(links.union(more))
    own = classes.select("k1", "k2", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    own = store(own.coalesce(1 + n_classes // FILE_ROWS), "components")
    for held in (near, forest, likely, members, open_, classes):
        held.unpersist()
    result = signed.select("doc_id", "n_shingles", "k1", "k2")
    out = result.join(own, ["k1", "k2"], "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))

"""An interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by workers (operator 6).

Counting: tasks add up the bigrams of their training documents; buckets of contexts add up the tasks'
sums, write their bigrams as sorted hash arrays and send on what concerns single words; buckets of
words write those arrays. Contexts that make up over a thousandth of the tokens (there are a thousand
at most) are dealt over all buckets. Nothing but counts of counts reaches the driver.

Scoring: each worker maps the arrays and looks up the sorted queries of a slice of texts.

The model has order 2: the arrays and shuffles of all trigrams alone take more than the disk that
goes with an operator of this kind (see README).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import _text
from tideline.llm._repeats import _flush, _groups
from tideline.llm._shared import columns_of_blobs, drop, mix, per_bucket, shared_dir, small_batches, store

#: Hashes that stand for a text's begin and end.
BEGIN, END = 0x5851F42D4C957F, 0x14057B7EF767814F >> 8
WORD = np.uint64((1 << 56) - 1)
BUCKET_ROWS = 400_000
HELD = 2_000_000
#: Bytes of text whose pairs are looked up together: fewer visits to each bucket.
SCORED = 1 << 21
BIGRAM_KEYS = (-7, 7, 4)  # context, word, count
WORD_KEYS = (-7, 5, 5, 5, 5, 5)  # word, count, types before it, types after it seen once, twice, more often


class Arrays:
    """Arrays by name in a folder of the shared store; opened ones are memory-mapped."""

    def __init__(self, uri: str):
        self.uri = uri
        self.open: dict[str, np.ndarray] = {}

    def _at(self, name: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(f"{self.uri}/{name}.npy")

    def write(self, name: str, array: np.ndarray) -> None:
        system, path = self._at(name)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"  # a task may run twice: the same content is moved in place
        with pa.PythonFile(system.open_output_stream(part), "w") as out:
            np.save(out, array)
        system.move(part, path)

    def get(self, name: str) -> np.ndarray:
        """The array; an empty one if there is none: buckets without rows write nothing."""
        if name not in self.open:
            system, path = self._at(name)
            if system.get_file_info(path).type == fs.FileType.NotFound:
                self.open[name] = np.zeros(0, np.uint64)
            elif isinstance(system, fs.LocalFileSystem):
                self.open[name] = np.load(path, mmap_mode="r")
            else:  # a store that can't be mapped: a copy that is gone as soon as it is mapped
                with tempfile.NamedTemporaryFile() as copy, system.open_input_stream(path) as source:
                    while block := source.read(1 << 24):
                        copy.write(block)
                    copy.flush()
                    self.open[name] = np.load(copy.name, mmap_mode="r")
        return self.open[name]


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, context, first): hashes of each text's words and end, of what stands before each, and each text's first token."""
    w = _text.words(buf, offsets, lower=True)
    h = np.insert(w.hash & WORD, w.first[1:], np.uint64(END))
    first = w.first + np.arange(len(w.first))
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[first[:-1]] = BEGIN
    return h, before, first


def pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(context + np.uint64(0x2545F4914F6CDD1D)) + word)


def _sum(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sums of values by keys, sorted by the keys."""
    order = np.lexsort(tuple(reversed(keys)))
    keys = [k[order] for k in keys]
    first = np.flatnonzero(np.diff(_groups(*keys), prepend=-1)) if len(order) else order
    return [k[first] for k in keys], [np.add.reduceat(v[order], first) if len(first) else v[order] for v in values]


def _bucket_key(context: np.ndarray, word: np.ndarray, hot: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(hot, context), max(0, len(hot) - 1))
    is_hot = hot[at] == context if len(hot) else np.zeros(len(context), bool)
    return np.where(is_hot, pair(context, word), mix(context))


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words that make up over 1 / 2000 of a task's tokens; at most 2000 rows."""
    words, counts, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    for batch in batches:
        buf, offsets = _text.raw(batch.column("text"))
        for i, j in _text.cut(offsets, 1 << 21):
            _, before, _ = tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            w, n = np.unique(before, return_counts=True)
            total += len(before)
            often = n * 4000 > len(before)
            (words,), (counts,) = _sum([np.concatenate([words, w[often]])], [np.concatenate([counts, n[often]])])
    keep = counts * 2000 > total
    yield pa.RecordBatch.from_pydict({"word": pa.array(words[keep].astype(np.int64)), "n": pa.array(counts[keep])})
    yield pa.RecordBatch.from_pydict({"word": pa.array([-1], pa.int64()), "n": pa.array([total], pa.int64())})


@dataclass
class Model:
    """Where the arrays are, the buckets, totals and discounts."""

    uri: str
    buckets: int
    hot: np.ndarray
    train_tokens: int
    vocabulary: int
    types: int
    pair_discount: np.ndarray  # for counts 0, 1, 2, 3 and more
    word_discount: np.ndarray
    word_types: np.ndarray  # words seen after 1, 2, 3 and more contexts

    def word_rows(self, arrays: Arrays, word: np.ndarray) -> np.ndarray:
        """count, types before, types after seen once, twice, more often: 5 x words, 0 for unknown ones. word: sorted."""
        out = np.zeros((5, len(word)), np.int64)
        bucket = ((mix(word) >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.int64)
        for b in np.unique(bucket).tolist():
            own = np.flatnonzero(bucket == b)
            keys = arrays.get(f"word-{b}")
            if len(keys):
                at = np.minimum(np.searchsorted(keys, word[own]), len(keys) - 1)
                hit = keys[at] == word[own]
                out[:, own[hit]] = arrays.get(f"counts-{b}")[:, at[hit]]
        return out

    def pair_counts(self, arrays: Arrays, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.zeros(len(word), np.int64)
        key = pair(context, word)
        bucket = ((_bucket_key(context, word, self.hot) >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.lexsort((key, bucket))
        edge = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(edge)).tolist():
            own = order[edge[b] : edge[b + 1]]
            keys = arrays.get(f"pair-{b}")
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, key[own]), len(keys) - 1)
            hit = keys[at] == key[own]
            n = arrays.get(f"times-{b}")[at[hit]].astype(np.int64)
            big = n == 255
            if big.any():
                n[big] = arrays.get(f"often-{b}")[1, np.searchsorted(arrays.get(f"often-{b}")[0], key[own[hit]][big])].astype(np.int64)
            out[own[hit]] = n
        return out

    def score(self, arrays: Arrays, buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        word, context, first = tokens(buf, offsets)
        both, at = np.unique(np.concatenate([word, context]), return_inverse=True)
        rows = self.word_rows(arrays, both)
        w, c = rows[:, at[: len(word)]], rows[:, at[len(word) :]]
        count = np.where(context == BEGIN, self._begins(arrays), c[0])
        d = self.word_discount
        spare = (d[1:] * self.word_types).sum() / max(self.types, 1) if self.types else 1.0
        p = np.maximum(w[1] - d[np.minimum(w[1], 3)], 0) / max(self.types, 1) + spare / (self.vocabulary + 1)
        n = self.pair_counts(arrays, context, word)
        d = self.pair_discount
        known = count > 0
        kept = np.maximum(n - d[np.minimum(n, 3)], 0)
        left = d[1] * c[2] + d[2] * c[3] + d[3] * c[4]
        p = np.where(known, (kept + left * p) / np.maximum(count, 1), p)
        base = np.log10((w[0] + 1) / (self.train_tokens + self.vocabulary + 1))
        cut = first[:-1]
        return {
            "n_tokens": np.diff(first),
            "n_known": np.add.reduceat((w[0] > 0).astype(np.int64), cut),
            "base_score": np.add.reduceat(base, cut),
            "score": np.add.reduceat(np.log10(p), cut),
        }

    def _begins(self, arrays: Arrays) -> int:
        """Texts that were learned from: each has one end."""
        return int(self.word_rows(arrays, np.array([END], np.uint64))[0, 0])


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, 3 and more from the counts of counts 1 .. 4; each between 0 and its count."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [0.0, *(k - (k + 1) * y * (b / a) if a else k * y for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))]
    # a discount of 0 would leave nothing for what was never seen
    return np.array([0.0, *(min(max(x, 0.1), k - 0.05) for k, x in zip((1, 2, 3), d[1:], strict=True))])


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Learns from every text of docs (a null text is an empty one: an end only). No rows give a model that knows nothing."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    frequent = rows.mapInArrow(_frequent, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    frequent = {r["word"]: r["n"] for r in frequent.orderBy(F.desc("n")).limit(4001).collect()}
    total = frequent.pop(-1, 0)
    hot = np.array(sorted(w for w, n in frequent.items() if n * 1000 > total), np.uint64)
    uri = f"{shared_dir(spark)}/tideline-model-{uuid.uuid4().hex}"
    buckets = max(12, -(-total // BUCKET_ROWS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list, list]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            (c, w), (n,) = _sum([np.concatenate(x) for x in zip(*(h[0] for h in held), strict=True)], [np.concatenate([h[1] for h in held])])
            for bucket, blob in _flush([(_bucket_key(c, w, hot), c, w, n.astype(np.uint64))], buckets, (0, *BIGRAM_KEYS)):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64()), "blob": pa.array([blob], pa.binary())})

        for batch in batches:
            buf, offsets = _text.raw(batch.column("text"))
            for i, j in _text.cut(offsets):
                w, c, _ = tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                held.append(([c, w], np.ones(len(w), np.int64)))
                size += len(w)
                if size > HELD:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    def pairs(table: pa.Table) -> pa.Table:
        bucket, arrays = table["bucket"][0].as_py(), Arrays(uri)
        _, c, w, n = columns_of_blobs(table["blob"].to_pylist(), (0, *BIGRAM_KEYS))
        (c, w), (n,) = _sum([c, w], [n.astype(np.int64)])
        k = pair(c, w)
        order = np.argsort(k, kind="stable")
        arrays.write(f"pair-{bucket}", k[order])
        arrays.write(f"times-{bucket}", np.minimum(n[order], 255).astype(np.uint8))
        big = order[n[order] >= 255]
        arrays.write(f"often-{bucket}", np.stack([k[big], n[big].astype(np.uint64)]))
        one, none = np.ones(len(w), np.int64), np.zeros(len(w), np.int64)
        (word,), sums = _sum(
            [np.concatenate([w, c])],
            [np.concatenate(x) for x in ((n, none), (one, none), (none, (n == 1) * one), (none, (n == 2) * one), (none, (n > 2) * one))],
        )
        sent = list(_flush([(mix(word), word, *(s.astype(np.uint64) for s in sums))], buckets, (0, *WORD_KEYS)))
        of = np.bincount(np.minimum(n, 5), minlength=6)
        once = {f"n{i}": pa.array([int(of[i]), *[0] * (len(sent) - 1)], pa.int64()) for i in range(1, 5)}  # with the first of the bucket's rows
        return pa.table({"bucket": pa.array([s[0] for s in sent], pa.int64()), "blob": pa.array([s[1] for s in sent], pa.binary())} | once)

    def singles(table: pa.Table) -> pa.Table:
        bucket, arrays = table["bucket"][0].as_py(), Arrays(uri)
        _, word, *sums = columns_of_blobs(table["blob"].to_pylist(), (0, *WORD_KEYS))
        (word,), sums = _sum([word], [s.astype(np.int64) for s in sums])
        counts = np.stack(sums)
        arrays.write(f"word-{bucket}", word)
        arrays.write(f"counts-{bucket}", counts.astype(np.uint32) if counts.max(initial=0) < 1 << 32 else counts)
        seen = counts[0] > 0  # the begin is a context only
        of = np.bincount(np.minimum(counts[1][seen], 5), minlength=6)
        stats = [*of[1:5].tolist(), int(of[5:].sum()), int(counts[0].sum()), int(seen.sum()), int(counts[1].sum())]
        return pa.table({f"s{i}": pa.array([x], pa.int64()) for i, x in enumerate(stats)})

    counted = ", ".join(f"n{i} long" for i in range(1, 5))
    sent = per_bucket(rows.mapInArrow(count, "bucket long, blob binary"), "bucket", buckets, pairs, "bucket long, blob binary, " + counted)
    sent = store(sent, "model-words", "uncompressed")
    of_pairs = [x or 0 for x in sent.agg(*[F.sum(f"n{i}") for i in range(1, 5)]).first()]
    schema = ", ".join(f"s{i} long" for i in range(8))
    done = store(per_bucket(sent.select("bucket", "blob"), "bucket", buckets, singles, schema), "model-totals")
    s = [x or 0 for x in done.agg(*[F.sum(f"s{i}") for i in range(8)]).first()]
    drop(sent, done)
    return Model(uri, int(buckets), hot, s[5], s[6], s[7], discounts(of_pairs), discounts(s[:4]), np.array([s[0], s[1], s[2] + s[3] + s[4]]))


_OPEN: dict[str, Arrays] = {}


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every text: log10 probabilities under add-one unigrams and the model."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.uri not in _OPEN:
            _OPEN.clear()
            _OPEN[model.uri] = Arrays(model.uri)
        for batch in batches:
            buf, offsets = _text.raw(batch.column("text"))
            for i, j in _text.cut(offsets, SCORED):
                found = model.score(_OPEN[model.uri], buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(i, j - i)} | {k: pa.array(v) for k, v in found.items()})

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(go, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def held_out_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2) -> DataFrame:
    """Learns from documents whose crc32 of the id as text leaves another remainder, and scores all.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then one end, a token too. Returns doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is an empty one (an end only); a null id is scored, not learned from and reported as
    held_out false; repeated rows are learned and scored each; an empty table gives an empty table;
    other columns are not read.
    """
    fold = F.crc32(F.col(f"`{id_col}`").cast("long").cast("string").cast("binary")) % modulus
    model = train(docs.where(fold != remainder), text_col)
    out = score(docs, model, id_col, text_col)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")

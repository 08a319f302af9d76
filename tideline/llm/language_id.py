"""Language identification by a bit-sliced Bloom filter over character n-grams (operator 9).

Each slot of the filter holds a bit for every language. A lookup takes the AND of the slots of an
n-gram and so returns all languages that contain it at once. A text's hits are counted by language;
counts are corrected for the share of false positives that the filter's fill implies; the language
with the most corrected hits wins.

An n-gram belongs to a language if at least `least_share` of its training documents hold it. This
bounds the filter whatever the corpus: documents hold a bounded mean number of different n-grams, so
at most that number divided by least_share n-grams pass for each language.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm import _text
from tideline.llm._shared import MIX_1, blobs_by_bucket, columns_of_blobs, mix, per_bucket, small_batches

GRAM_BYTES = 4
PROBES = 4
UNKNOWN = "und"
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4-byte grams of the texts as uint32, and each text's first: letters only, one space between words and around."""
    b = _LETTERS[buf]
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    before = np.concatenate([[0], np.cumsum(keep)])
    edge = before[offsets]
    b = b[keep]
    rows = len(offsets) - 1
    b = np.insert(b, np.concatenate([edge[:-1], np.repeat(edge[1:], 2)]), np.uint8(32))  # all spaces, so their order is no matter
    edge = edge + 3 * np.arange(rows + 1)
    n = len(b) - 3
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
    g = b[:n].astype(np.uint32) | b[1 : n + 1].astype(np.uint32) << 8 | b[2 : n + 2].astype(np.uint32) << 16 | b[3:].astype(np.uint32) << 24
    ok = np.ones(n, bool)
    for k in range(1, GRAM_BYTES):  # not across texts
        at = edge[1:-1] - k
        ok[at[at >= 0]] = False
    count = np.concatenate([[0], np.cumsum(ok)])
    return g[ok], count[np.minimum(edge, n)]


def slots_of(g: np.ndarray, size: int) -> Iterator[np.ndarray]:
    h = mix(g.astype(np.uint64) + np.uint64(MIX_1))
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield ((h + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64)


@dataclass
class Languages:
    """A fitted model. names: in order of their bits; table: a mask of up to 64 languages in each slot, in so many planes."""

    names: list[str]
    table: list[np.ndarray]

    def false_share(self) -> np.ndarray:
        """Each language's chance of a hit by an n-gram that it doesn't hold."""
        fill = [((self.table[i // 64] >> np.array(i % 64, self.table[i // 64].dtype)) & 1).mean() for i in range(len(self.names))]
        return np.array(fill, float) ** PROBES

    def predict(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, its share of all corrected hits) of each text."""
        g, first = grams(buf, offsets)
        rows, n = len(offsets) - 1, np.diff(first)
        hits = np.zeros((len(self.names), rows))
        for plane, table in enumerate(self.table):
            mask = None
            for at in slots_of(g, len(table)):
                mask = table[at] if mask is None else mask & table[at]
            for i in range(64 * plane, min(64 * plane + 64, len(self.names))):
                sums = np.concatenate([[0], np.cumsum((mask >> np.array(i % 64, mask.dtype)) & 1, dtype=np.int64)])
                hits[i] = sums[first[1:]] - sums[first[:-1]]
        wrong = self.false_share()[:, None]
        hits = np.maximum(0, (hits - n * wrong) / (1 - wrong + 1e-12))
        total = hits.sum(axis=0)
        best = hits.argmax(axis=0)
        return best, np.where(total > 0, hits[best, np.arange(rows)] / np.maximum(total, 1e-12), 0.0)


def build(names: list[str], pairs_language: np.ndarray, pairs_gram: np.ndarray) -> Languages:
    size = 1 << max(10, int(np.ceil(np.log2(max(1, 12 * len(np.unique(pairs_gram)))))))
    planes = []
    for plane in range(-(-len(names) // 64) or 1):
        width = min(64, len(names) - 64 * plane)
        kind = np.uint8 if width <= 8 else np.uint16 if width <= 16 else np.uint32 if width <= 32 else np.uint64
        table = np.zeros(size, kind)
        for i in range(64 * plane, 64 * plane + max(0, width)):
            own = pairs_gram[pairs_language == i]
            for at in slots_of(own, size):
                table[at] |= np.array(1 << (i % 64), kind)
        planes.append(table)
    return Languages(names, planes)


GRAM_KEYS = (0, 4, 2, 5)  # hash (not sent), n-gram, language, documents
HELD = 2_000_000


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of the texts in lower case; a null is an empty text."""
    return _text.raw(pc.utf8_lower(column))


def _count(number: dict[str, int], n_buckets: int):
    """Texts with their languages to blobs of (n-gram, language, documents that hold it) by bucket of the n-gram."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        size = 0

        def fold() -> None:
            nonlocal keys, counts, held, size
            k, n = np.unique(np.concatenate(held), return_counts=True)
            keys, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n])).astype(np.int64)
            held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            gram = keys & np.uint64(0xFFFFFFFF)
            key = mix(gram + np.uint64(MIX_1))
            for bucket, blob in blobs_by_bucket([key, gram, keys >> np.uint64(32), counts.astype(np.uint64)], n_buckets, GRAM_KEYS):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64()), "blob": pa.array([blob], pa.binary())})

        for batch in batches:
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.uint64)
            buf, offsets = lowered(batch.column("text"))
            for i, j in _text.cut(offsets):
                g, first = grams(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                row = np.unique(np.repeat(np.arange(j - i, dtype=np.uint64), np.diff(first)) << np.uint64(32) | g)
                held.append(lang[i:j][(row >> np.uint64(32)).astype(np.int64)] << np.uint64(32) | row & np.uint64(0xFFFFFFFF))
                size += len(row)
                if size > HELD:
                    fold()
                    if len(keys) > HELD:
                        yield from out()
                        keys, counts = keys[:0], counts[:0]
        if held:
            fold()
        if len(keys):
            yield from out()

    return go


def _choose(docs: np.ndarray, least_share: float):
    """Of one bucket's sums: (language, n-gram) pairs of which the language's documents hold a share of least_share at least."""

    def go(table: pa.Table) -> pa.Table:
        _, gram, lang, n = columns_of_blobs(table["blob"].to_pylist(), GRAM_KEYS)
        key, at = np.unique(lang << np.uint64(32) | gram, return_inverse=True)
        share = np.bincount(at, n) / docs[(key >> np.uint64(32)).astype(np.int64)]
        key = key[share >= least_share]
        return pa.table({"lang": pa.array((key >> np.uint64(32)).astype(np.int64)), "gram": pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64))})

    return go


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", least_share: float = 0.002) -> Languages:
    """Counts, over all rows of train, the documents of each language that hold each n-gram; builds the filter.

    Rows with a null text or language teach nothing; no rows give a model without languages.
    """
    small_batches(train.sparkSession)
    rows = train.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    by_lang = sorted(map(tuple, rows.groupBy("lang").count().collect()))  # a row for each language
    names = [x for x, _ in by_lang]
    n_buckets = max(12, int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sent = rows.mapInArrow(_count({x: i for i, x in enumerate(names)}, n_buckets), "bucket long, blob binary")
    chosen = _choose(np.array([n for _, n in by_lang], float), least_share)
    table = per_bucket(sent, "bucket", n_buckets, chosen, "lang long, gram long").toArrow()
    return build(names, table["lang"].to_numpy(), table["gram"].to_numpy().astype(np.uint32))


def _predicted(batch: pa.RecordBatch, place: int, model: Languages) -> tuple[pa.Array, np.ndarray]:
    """lang_pred and score of each row."""
    text = batch.column(place)
    buf, offsets = lowered(text)
    best, share = np.zeros(len(text), np.int64), np.zeros(len(text))
    if model.names:
        for i, j in _text.cut(offsets):
            best[i:j], share[i:j] = model.predict(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
    letter = np.asarray(pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False)) & bool(model.names)
    names = pa.array([*model.names, UNKNOWN], pa.string())
    return names.take(pa.array(np.where(letter, best, len(model.names)))), np.where(letter, share, 0.0)


def predict(docs: DataFrame, model: Languages, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score to docs, from the text alone.

    A text that is null or has no letter, or a model without languages, gives `und` and 0. Letters
    in no known n-gram give the first language with score 0. All rows and columns are kept; columns
    of these names are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    place = [f.name for f in kept].index(text_col)
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, share = _predicted(batch, place, sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, lang, pa.array(share)], [f.name for f in schema.fields])

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(go, schema)


def drop_unidentified(docs: DataFrame, model: Languages, text_col: str = "text") -> DataFrame:
    """docs without the rows that `predict` gives `und`, all columns kept. A model without languages rejects nothing."""
    spark = docs.sparkSession
    if not model.names:
        return docs
    small_batches(spark)
    sent, place = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.not_equal(_predicted(batch, place, sent.value)[0], UNKNOWN))

    return docs.mapInArrow(go, docs.schema)


def held_out(id_col: str = "doc_id", modulus: int = 4, remainder: int = 2):
    """Whether crc32 of the id as text leaves this remainder."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % modulus == remainder


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, remainder: int = 2) -> DataFrame:
    """Fits on the documents that are not held out and predicts all; returns doc_id, held_out, lang_pred, score.

    A null id is held out of learning (its remainder is null) and reported as held_out false. Repeated
    rows teach and are predicted each; an empty table gives an empty table; other columns are not read.
    """
    model = fit(docs.where(~held_out(id_col, modulus, remainder)), text_col, lang_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = F.coalesce(held_out(id_col, modulus, remainder), F.lit(False))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), out.alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, share = _predicted(batch, 2, sent.value)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": lang, "score": pa.array(share)})

    return rows.mapInArrow(go, "doc_id long, held_out boolean, lang_pred string, score double")

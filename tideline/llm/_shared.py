"""Places and sizes shared by the operators: tables in the cluster's shared folder, task ids, blobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Multipliers of the 64-bit mixer used for every hash here.
MIX_1, MIX_2, MIX_3 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where it is unset (tests, one machine) a temporary folder is taken and set.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tideline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Settings for rows of whole texts, where the session has Spark's defaults: name, default, value.
TEXT_SETTINGS = (
    ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"),
    ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"),
    ("spark.sql.parquet.columnarReaderBatchSize", "4096", "32"),
)


def small_batches(spark: SparkSession) -> None:
    """Rows of whole texts are read 32 at a time and go to Python a thousand and 4 MB at a time: the defaults fit numbers, and make arrays of a hundred MB of texts."""
    for key, default, small in TEXT_SETTINGS:
        if spark.conf.get(key) == default:
            spark.conf.set(key, small)


#: Folders written by `store` in this process and not yet deleted.
_STORED: set[str] = set()


#: Bytes of a page of stored tables: a writer holds one for each column.
PAGE_BYTES = 1 << 17


def store(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tideline-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).option("parquet.page.size", PAGE_BYTES).option("parquet.dictionary.page.size", PAGE_BYTES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tideline_path = path
    _STORED.add(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _STORED.discard(path)


def drop(*tables: DataFrame) -> None:
    """Deletes stored tables that no later result reads."""
    for t in tables:
        _delete(t.sparkSession, t._tideline_path)


def hold(df: DataFrame) -> DataFrame:
    """Keeps a small table on the executors' disks while it is read several times; what a lost executor held is made again from its stored sources. Ends with unpersist()."""
    return df.persist(StorageLevel.DISK_ONLY)


#: Partitions of one exchange by number; more buckets than that share partitions, and are then sorted.
MOST_PARTITIONS = 8192


def per_bucket(rows: DataFrame, bucket: str, n: int, function: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """function over all rows of each bucket (numbers 0 .. n - 1), in one exchange.

    A bucket has a partition of its own, so nothing is sorted; beyond MOST_PARTITIONS buckets, those that
    share a partition are put in order and still handled one by one.
    """
    parts = min(n, MOST_PARTITIONS)
    place = rows.columns.index(bucket)
    dealt = rows.repartitionById(parts, F.pmod(F.col(bucket), F.lit(parts)).cast("int"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            keys = np.asarray(batch.column(place))
            edge = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if j > i:
                    if held and keys[i] != key:
                        yield from function(pa.Table.from_batches(held)).to_batches()
                        held = []
                    key = keys[i]
                    held.append(batch.slice(i, j - i))
        if held:
            yield from function(pa.Table.from_batches(held)).to_batches()

    return (dealt.sortWithinPartitions(bucket) if n > parts else dealt).mapInArrow(go, schema)


def stored() -> set[str]:
    """Folders that `store` has written and nobody has deleted."""
    return set(_STORED)


def release(spark: SparkSession, keep: set[str] | frozenset[str] = frozenset()) -> None:
    """Deletes what `store` has written, but for the folders in keep. For callers whose results are written: lazy results still read these tables."""
    for path in stored() - set(keep):
        _delete(spark, path)


def distinct_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id and text, under the names doc_id and text, whatever else the table has."""
    small_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective mixing of uint64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(MIX_2)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(MIX_3)
    return h ^ (h >> np.uint64(31))


def squeeze(raw: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def expand(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def planes(a: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value, one plane of bytes after the other (planes compress; mixed bytes don't)."""
    b = np.ascontiguousarray(a, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return np.ascontiguousarray(b.T).tobytes()


def from_planes(raw: bytes, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8").ravel(), at + n * width


def blobs_by_bucket(columns: list[np.ndarray], n_buckets: int, keys: tuple[int, ...], by: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
    """Columns of 64-bit values to one blob for each bucket of the first column, a hash (or of `by`). keys: bytes kept of each column; negative: as differences."""
    bucket = ((columns[0] if by is None else by) >> np.uint64(40)) % np.uint64(n_buckets)
    order = np.argsort(bucket, kind="stable")
    edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
    columns = [c[order] for c in columns]
    for i, j in zip(edge[:-1], edge[1:], strict=True):
        if j > i:
            parts = [np.int64(j - i).tobytes()]
            for c, width in zip(columns, keys, strict=True):
                x = c[i:j].astype(np.uint64)
                parts.append(planes(np.diff(x, prepend=np.uint64(0)) if width < 0 else x, abs(width)))
            yield int(bucket[order[i]]), squeeze(b"".join(parts))


def columns_of_blobs(blobs: list[bytes], keys: tuple[int, ...]) -> list[np.ndarray]:
    """What `blobs_by_bucket` has put into the blobs of a bucket, as columns."""
    got: list[list[np.ndarray]] = [[] for _ in keys]
    for blob in blobs:
        data = expand(blob)
        n, at = int(np.frombuffer(data, "<i8", 1)[0]), 8
        for k, width in enumerate(keys):
            x, at = from_planes(data, at, n, abs(width))
            got[k].append(np.cumsum(x, dtype=np.uint64) if width < 0 else x)
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in got]

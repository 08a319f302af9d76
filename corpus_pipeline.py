"""A corpus pipeline: language identification, near-duplicate removal, removal of repeated passages, decontamination, packing.

Each stage works on all that the stage before kept, and returns the columns of documents, but for the
last one, which returns where each piece of a document is packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm._shared import hold, release, store, stored
from tideline.llm.decontaminate import drop_contaminated
from tideline.llm.language_id import drop_unidentified, fit, held_out
from tideline.llm.near_dedup import SENT_IDS, near_duplicates
from tideline.llm.packing import pack_documents
from tideline.llm.substring_dedup import cut_repeated_windows

#: Repeated passages of this many words go, but for the first.
PASSAGE_WORDS = 50
SEQUENCE_TOKENS = 2048
TOKENIZER = "word_bpe_49k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns the languages from the documents' labels (three folds of four); drops documents of no language (no letters).

    Null and empty texts have no letters and go; null labels teach nothing, and without any labelled
    row nothing is rejected. Repeated rows are judged alike, ties go to the first language by name;
    other columns are kept as they are, an empty table stays one.
    """
    model = fit(docs.where(~held_out("doc_id")), "text", "lang")
    return drop_unidentified(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest id stays.

    Null, empty and white texts are alike nothing and stay, rows with a null id too; of repeated rows
    (one id, one text) all stay or all go; other columns are kept as they are, an empty table stays one.
    """
    found = hold(near_duplicates(docs, shingle=5, percent=80).where(~F.col("kept")).select("doc_id").distinct())
    n = found.count()
    gone = store(found.coalesce(1 + n // SENT_IDS), "gone")
    found.unpersist()
    # 8 bytes each; more are joined by a shuffle
    return docs.join(F.broadcast(gone) if n <= SENT_IDS else gone, "doc_id", "left_anti").select(*docs.columns)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that also start earlier; n_chars, where there is such a column, is counted again.

    Null texts stay null (their n_chars too), empty ones empty; a null id counts as the largest, rows
    with one id are taken in the order in which they are met, so that of repeated rows the first keeps its
    passages; no row is dropped, other columns are kept as they are, an empty table stays one.
    """
    out = cut_repeated_windows(docs, window=PASSAGE_WORDS)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain an item of the benchmark (0.8 of its five-word shingles).

    Null and empty texts contain nothing and stay, null and empty items are contained nowhere; each
    repeated row is judged alike; columns are kept as they are, empty tables give what was there.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenizes and packs what is left into sequences.

    A null or empty text is a piece of one id (the 0 at its end); null ids stay null, repeated rows are
    packed each; the result has the columns of the packing only, an empty table gives none.
    """
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path(TOKENIZER), size=SEQUENCE_TOKENS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_passages),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Filters fitted on counts, hash bands and packing can't be said in SQL; tests/llm compares stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage is written and read again, and what it had stored on the way is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = stored()
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, before | {docs._tideline_path})
    return docs

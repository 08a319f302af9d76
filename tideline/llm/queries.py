"""The registered queries of the operators, thin: production parameters over whole tables, digests of the results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.decontaminate import contained
from tideline.llm.language_id import identify
from tideline.llm.language_model import held_out_scores
from tideline.llm.licenses import scan
from tideline.llm.near_dedup import near_duplicates
from tideline.llm.packing import pack_documents
from tideline.llm.spot_signatures import fingerprint_report
from tideline.llm.substring_dedup import remove_repeated_windows
from tideline.llm.suffix_dedup import remove_repeated_bytes
from tideline.llm.token_counts import count_tokens


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_windows(_documents(spark, sf_dir), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(_documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=5, percent=80)


def _vocabulary(name: str) -> str:
    """The place of a public tokenizer's file on this machine and every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"), size=2048)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"), limit=1024)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_scores(_documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_documents(spark, sf_dir), least=0.8)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), shingle=2, percent=80)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(_documents(spark, sf_dir), window=400, least=256)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("longest_repeat") > 0).cast("long").alias("repeats_256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_decontamination": op3_decontamination,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_token_counts": op5_token_counts,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_license_scan": op7_license_scan,
    "op8_near_dedup": op8_near_dedup,
    "op9_language_id": op9_language_id,
    "op10_suffix_dedup": op10_suffix_dedup,
}

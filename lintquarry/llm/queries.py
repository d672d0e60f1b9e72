"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import audit, bpe, chat, decontam, hilbert, html_text, langid, line_dedup, merkle, neardup, quality, tiff, token_counts
from .common import read


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_texts(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), bpe_pattern())


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(read(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(read(spark, sf_dir, "conversations"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard_documents(read(spark, sf_dir, "documents"))


def op10_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.store_texts(read(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_documents(read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_documents(read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality, op2_byte_bpe, op3_language, op4_near_duplicates, op5_decontaminate, op6_tool_calls, op7_html_text, op8_token_counts, op9_hilbert_shards, op10_tiff_media, op11_line_dedup, op12_filter_audit, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op6_tool_calls": chat.ORACLE_SQL, "op11_line_dedup": line_dedup.ORACLE_SQL, "op12_filter_audit": audit.ORACLE_SQL, "op13_merkle_manifest": merkle.ORACLE_SQL}

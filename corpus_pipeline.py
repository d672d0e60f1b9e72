"""From raw documents to token ids: quality, language, near duplicates, benchmark leaks, byte-level BPE.

Each stage takes what the one before kept, written as Parquet and read again, and its decisions take effect: the quality
classifier and the language identifier drop the documents that they reject, one document of each group of near duplicates
stays, documents that hold a benchmark item go. All stages but the last return the columns of ``documents``; the last one
returns doc_id, n_tokens and digests of the token ids and of the decoded bytes.

Defined results: a null or empty text gets the classifier's score of no features, and is dropped as a text of no language; rows of
a repeated or null doc_id are judged each for itself, near duplicates among them as any others; very long texts are read whole; ties
between near duplicates go to the row that is stored first; empty tables give no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lintquarry.llm import bpe, decontam, langid, neardup, quality
from lintquarry.llm.common import Shared, read
from lintquarry.llm.queries import bpe_pattern, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs.select(COLUMNS), read(spark, sf_dir, "labels"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs.select(COLUMNS))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs.select(COLUMNS))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs.select(COLUMNS), read(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digest_texts(docs, tokenizer("byte_bpe_50k.tiktoken"), bpe_pattern())


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_leaks),
    ("byte_bpe", token_ids),
]

#: SQL can't express the stages; each is tested against a brute-force version or held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents table."""
    shared = Shared(spark, "corpus")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.table(docs)
    return docs

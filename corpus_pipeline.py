"""The corpus pipeline: stages applied to ``documents`` one after the other.

Every stage but the last returns the columns of ``documents``; its rows are written to the shared
folder and read again as the documents of the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trendloom.llm import decontaminate, near_dedup, piece_codec, quality_rules, suffix_dedup
from trendloom.llm.common import settle, small_batches, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep all quality rules."""
    return quality_rules.filter_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    small_batches(spark)
    return near_dedup.keep_one_of_each(docs)


#: Bytes of the strings that may stand only once: fewer than 51 short words have.
REPEATED_BYTES = 250


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of byte strings that repeat among those still here."""
    small_batches(spark)
    return suffix_dedup.cut_documents(docs, REPEATED_BYTES)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them, by document."""
    small_batches(spark)
    return piece_codec.digest_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_copies),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece encoding and decoding", encode),
]

#: Shingle sets, byte strings and token ids are beyond SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs

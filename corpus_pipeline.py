"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage works on all rows its predecessor kept and returns the columns of ``documents``; the last returns token windows. A stage runs its inner steps
when it is called, and removes their tables again before it returns, but for those its result reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelforge.functions.staging import staged
from panelforge.llm import cuckoo, langid, nearcopies, suffixes
from panelforge.llm.queries import pack_tokens

#: Near-duplicates: shingles of five words, similarity of 0.8 (``nearcopies.SHARE``).
WORDS = 5
#: A repeated passage goes if it holds more than fifty words; shortest repeated byte string that is looked at: 51 words of two letters or less with their spaces.
PASSAGE_WORDS = 50
REPEAT = 128

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be told: those without a letter go, and those the classifier finds in no learned language."""
    return langid.accepted(docs, langid.fit(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays."""
    return cuckoo.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (found by SimHash tables and completed by prefixes), the document with the smallest id stays."""
    return nearcopies.representatives(docs, WORDS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over fifty words that occur elsewhere too; n_chars follows. Characters cut in half go as a whole."""
    return suffixes.shortened(docs, REPEAT, PASSAGE_WORDS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of what is left."""
    return pack_tokens(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("suffix_dedup", repeated_passages),
    ("packing", packed),
]

#: SQL cannot express the stages; they are tested against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

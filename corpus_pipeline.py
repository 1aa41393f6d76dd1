"""A pipeline of five operators over documents: what each stage keeps is the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyweave.llm.common import documents, made, release, work_dir
from tallyweave.llm.langid import keep_known
from tallyweave.llm.packing import pack
from tallyweave.llm.quality import keep_good
from tallyweave.llm.simhash import keep_one
from tallyweave.llm.suffix import without_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep; null and empty texts go."""
    return keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; texts without a letter go."""
    return keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id."""
    return keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the 200-byte strings that stand more than once; what is left may be an empty text."""
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of 2048 tokens; an empty text is a piece of the end id."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, 0)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("packing", packing),
]

#: The stages can't be put into SQL (a trained model, transforms, a local search); tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again; the rows of the last.

    Nulls, ties, repeated rows and clashing columns are as each stage says; an
    empty table goes through and gives no rows. What a stage wrote for itself is
    removed when its result is, and that with the next one's, but for the last.
    """
    docs, before = documents(spark, sf_dir), made(spark)
    for name, stage in STAGES:
        path = work_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark, before, keep=(path,))
    return docs

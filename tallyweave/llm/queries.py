"""The queries of this folder and, where SQL can express one, its SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import licenses
from . import quality as rules
from .common import documents
from .hmm import score
from .langid import identify
from .multiset_hash import edited_fingerprints
from .packing import pack
from .pieces import encode_decode
from .simhash import near_duplicates
from .suffix import remove_repeats
from .token_files import token_files

#: The vocabulary that token counts refer to.
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def op1_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a hidden Markov model of those that are not held out, beside the unigram base."""
    return score(documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of at most 2048 tokens."""
    return pack(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), 2048, 0)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written in ascending doc_id order and read back."""
    return token_files(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), 2)


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts, and how alike they and the next ones are."""
    return edited_fingerprints(documents(spark, sf_dir))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents, and components of those at 3 or fewer differing bits."""
    return near_duplicates(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learnt from those that are not held out."""
    return identify(documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence that each text is, and those that its lines name."""
    return licenses.scan(documents(spark, sf_dir))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text in the sentencepiece model's ids, and back."""
    return encode_decode(documents(spark, sf_dir), public_tokenizers.path(PIECE_BPE))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text without the 200-byte strings that stand more than once in all texts."""
    return remove_repeats(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures of each text, the base rule and the verdict."""
    return rules.quality(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_hidden_markov_scores, op2_best_fit_packing, op3_token_files, op4_document_fingerprints, op5_simhash_near_dedup, op6_language_id, op7_license_scan, op8_sentence_pieces, op9_suffix_array_dedup, op10_quality_rules)}
ORACLE_SQL: dict[str, str] = {"op7_license_scan": licenses.oracle(), "op10_quality_rules": rules.oracle()}

"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timberline.llm._common import materialize, table
from timberline.llm.line_dedup import EXACT_CHARS, without_duplicates
from timberline.llm.mixing import mixed_documents
from timberline.llm.near_dedup import without_near_duplicates
from timberline.llm.packing import pack
from timberline.llm.quality_rules import keep_good

#: Near duplicates share at least 80 % of their five-word shingles.
SHINGLE_WORDS = 5
#: Longest sequence, in tokens, and the vocabulary that counts them.
SEQUENCE_TOKENS = 2048
VOCABULARY = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or repeat themselves too much go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines within one edit of an earlier line go, short ones if equal to it; so do
    documents left without words."""
    return without_duplicates(docs, exact_chars=EXACT_CHARS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return without_near_duplicates(docs, width=SHINGLE_WORDS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights: documents stay as often as the mix takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences; a document taken twice is packed twice."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path(VOCABULARY), capacity=SEQUENCE_TOKENS)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can't tokenize, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

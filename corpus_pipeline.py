"""A corpus pipeline: documents are graded, freed of near copies and of secrets, and packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import jaccard_join, packing, quality, secrets
from gridloom.llm.common import read_table, settle
from gridloom.llm.queries import tokenizer_file


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the ordinal classifier rejects; it is trained on all labelled documents."""
    return quality.keep_good(docs, quality.train_classifier(docs, quality.graded(read_table(spark, sf_dir, "labels"))))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies (five-word shingles, similarity 0.8)."""
    return jaccard_join.keep_one(docs, jaccard_join.similar_groups(docs, words=5, numerator=80, denominator=100))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets that the forest confirms."""
    return secrets.redact_documents(docs, secrets.default_forest(spark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of at most 2048."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality", good_quality), ("near copies", one_of_each_group), ("secrets", without_secrets), ("packing", packed)]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on the documents."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
    return docs

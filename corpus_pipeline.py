"""Corpus pipeline: quality rules, exact dedup, near-dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm.common import read_table, stored
from granary.llm.exact_dedup import drop_exact_duplicates
from granary.llm.packing import pack_documents
from granary.llm.quality_rules import keep_good
from granary.llm.simhash import keep_one_per_group


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the smallest doc_id."""
    return keep_one_per_group(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all remaining documents, each in its sequence."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    *filters, (_, last) = STAGES
    for name, stage in filters:
        docs = stored(stage(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)


#: SQL has neither SimHash nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None

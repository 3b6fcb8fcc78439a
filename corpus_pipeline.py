"""A training corpus from raw documents: each stage takes what the one before it kept.

The first four return the columns of documents; packing returns a row for each piece of a document and its bin.
Rows, ties, nulls and empty tables: see the operator that a stage calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import exact_dedup, near_copies, packing, quality_rules, suffix_dedup
from millrace.llm.common import durable, read


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules hold to be good."""
    return quality_rules.keep(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.deduplicate(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (links of similarity 0.8 or more between sets of five-word shingles)."""
    return near_copies.keep_first(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages that an earlier place has, too."""
    return suffix_dedup.remove(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its words and the bin that holds it."""
    return packing.pack(packing.items(docs))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("best_fit_packing", packing_stage),
]

#: Expectation-maximisation, connected components and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = durable(docs)
    return docs

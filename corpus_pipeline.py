"""The corpus pipeline: quality rules, exact duplicates, near duplicates, mixing, packing.

Every stage takes the documents that the one before it kept and returns documents, the last one packed sequences. A
stage's result is written as Parquet in the shared folder and read again, so a lost executor costs one stage at most.
The behaviour on nulls, empty or long texts, ties, repeated rows, empty tables and further columns is that of the
operators; each docstring states it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallystar.llm import exact_dedup, mixing, packing, quality, simhash
from tallystar.llm.shared import written
from tallystar.queries.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie below the likelihood threshold go."""
    return quality.accept(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.deduplicate(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their target shares."""
    return mixing.mix(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences of 2048."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("sequence_packing", sequence_packing),
]

# Tokenizer, fingerprints and the likelihood ratio are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

"""From raw documents to packed training sequences.

STAGES are applied in order by run(); each works on all rows that the one before kept, and all but the
last return the columns of documents. Null ids, texts and sources, repeated rows, empty tables and
further columns have the results that the operators state: an empty text fails the quality rules, equal
rows are one, a null source is a source of its own, null ids rank behind all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vidspark.llm import content_sort, mixing, packing, quality_rules, simhash
from vidspark.llm.queries import word_tokenizer
from vidspark.session import stored


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.kept_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, the one with the smallest id."""
    return content_sort.first_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their five-word shingles, the one with the smallest id."""
    return simhash.first_of_groups(docs, words=5, least=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share of the mix takes it."""
    return mixing.mixed_documents(docs, weights=(3, 1, 2), share=1.5, cap=2.0)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its token ids, its sequence and its place there."""
    return packing.packed(docs, word_tokenizer(), capacity=4096, end=1, with_ids=True)


STAGES = [("quality_rules", rules), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", sequences)]

#: The fingerprints, the search in their trees and the tokens are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

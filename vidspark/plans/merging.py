"""From a scan for duplicate names to merged persons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidspark.operators.naming import merge_candidates
from vidspark.operators.workflow import apply_decisions
from vidspark.params import MergeRules
from vidspark.session import cut_lineage


def merge_duplicates(persons: DataFrame, vectors: DataFrame, *, types: tuple[str, ...] = ("DUPLICATE",), rules: MergeRules = MergeRules()) -> tuple[DataFrame, DataFrame]:
    """Apply every candidate of the given types as a merge into the lower id."""
    found = cut_lineage(merge_candidates(persons, rules=rules).filter(F.col("type").isin(*types)).filter("target_id IS NOT NULL"))
    decisions = found.select(
        F.greatest("source_id", "target_id").alias("source_id"), F.lit("MERGE").alias("action"), F.least("source_id", "target_id").alias("target_id"), F.lit(None).cast("string").alias("new_name")
    )
    return apply_decisions(persons, vectors, decisions)

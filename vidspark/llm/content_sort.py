"""Exact duplicates by content sort.

Sampled splitters range-partition the normalised texts, each partition is sorted externally, so that
equal texts stand next to each other, and neighbours are compared in full. The sort key is the head of
the text (`HEAD` characters, so that the splitters the driver sees stay small), a 64-bit hash of the
whole of it, the salt and the text itself.

A text that fills a noticeable part of a partition (seen in a bounded sample; this only decides the
layout) is salted by its id: its copies are sorted in several runs, and the runs meet in one aggregate
with partial sums, compared in full again.

Defined results: null text counts as empty; null ids rank behind all others; of rows equal in text and
id exactly one stays; an empty table gives an empty result; further columns are carried or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vidspark.llm.text import spaced

HEAD = 32
#: Sampled rows per partition, and how many of them make a text hot.
SAMPLED, HOT = 20, 3


def hot_hashes(keys: DataFrame, partitions: int) -> list[int]:
    """Hashes of texts that fill a good part of a partition: at most SAMPLED / HOT per partition."""
    rows = keys.count()
    if rows == 0:
        return []
    sample = keys.sample(min(1.0, SAMPLED * partitions / rows), seed=7).select(F.xxhash64(spaced(F.col("_t"))).alias("_h"))
    return [r["_h"] for r in sample.groupBy("_h").count().filter(F.col("count") >= HOT).collect()]


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row as `_row` (its columns but the text) and `_t`, with its group's lowest id, size, digest
    and whether it stays. The text crosses the one shuffle once and is normalised again behind it."""
    spark = docs.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(None).alias("none")]).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_t"))
    norm: Column = spaced(F.col("_t"))
    hot = hot_hashes(rows.select("_t"), partitions)
    rows = rows.withColumn("_norm", norm).withColumn("_hash", F.xxhash64("_norm")).withColumn("_head", F.substring("_norm", 1, HEAD)).drop("_norm")
    # equal ids share a salt, so the rows with the lowest id of a group stand in one run
    salt = F.when(F.col("_hash").isin(hot), F.pmod(F.xxhash64("_id"), F.lit(partitions))) if hot else F.lit(None)
    laid = rows.withColumn("_salt", salt.cast("long")).repartitionByRange("_head", "_hash", "_salt").withColumn("_norm", norm)
    run = W.partitionBy("_head", "_hash", "_salt", "_norm")
    order = run.orderBy(F.col("_id").asc_nulls_last())
    out = laid.select(
        "_row", "_id", "_t", F.row_number().over(order).alias("_rank"), F.first("_id").over(order).alias("_low"),
        F.count(F.lit(1)).over(run).alias("_n"), F.sha2(F.encode("_norm", "UTF-8"), 256).alias("_sha"),
    )
    if hot:
        again = docs.select(F.col(f"`{id_col}`").alias("_id"), spaced(F.col(f"`{text_col}`")).alias("_norm")).filter(F.xxhash64("_norm").isin(hot))
        again = again.groupBy("_norm").agg(F.min("_id").alias("_all_low"), F.count(F.lit(1)).alias("_all"))
        # at most SAMPLED / HOT rows per partition
        out = out.join(F.broadcast(again.select(F.sha2(F.encode("_norm", "UTF-8"), 256).alias("_sha"), "_all_low", "_all")), "_sha", "left")
        out = out.withColumn("_low", F.when(F.col("_all").isNotNull(), F.col("_all_low")).otherwise(F.col("_low"))).withColumn("_n", F.coalesce("_all", "_n"))
    return out.withColumn("_stays", (F.col("_rank") == 1) & F.col("_id").eqNullSafe(F.col("_low")))


def decisions(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows: doc_id, keep_id, group_size, kept, text_sha256."""
    out = _judged(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), "doc_id", "text")
    return out.select(F.col("_id").alias("doc_id"), F.col("_low").alias("keep_id"), F.col("_n").alias("group_size"), F.col("_stays").alias("kept"), F.col("_sha").alias("text_sha256"))


def first_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with exactly the columns of `docs`; nothing is joined back."""
    kept = _judged(docs, id_col, text_col).filter("_stays")
    return kept.select(*[F.col("_t").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])

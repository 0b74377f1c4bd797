"""Helpers shared by the operators: parameter tables, group maxima, runs, ordered numbering."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vidspark.session import cut_lineage


def parameter_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A table of fixed parameters. Its size is that of the argument, so it may be broadcast."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitioned on `keys` into a stated number of partitions: for little bytes and much
    arithmetic (Python tasks), where coalescing by size would leave cores idle."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)  # without keys: round robin


def with_group(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Attach group aggregates by aggregate + join: partial sums before the shuffle, and a hot key
    is split by the adaptive skew join, which a window over the same keys would not allow."""
    return df.join(df.groupBy(*keys).agg(*aggs), list(keys), "left")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best k rows per group. Spark limits each partition to k rows per key before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Newest row per key as an aggregate (combines before the shuffle, so hot keys are harmless)."""
    rest = [c for c in df.columns if c not in keys]
    stamp = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), stamp).alias("_row"))
    return packed.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def runs(points: DataFrame, keys: Sequence[str], pos: str, *, max_gap: int, block: int = 100_000) -> DataFrame:
    """Runs of positions whose neighbours are at most `max_gap` apart.

    Two levels, so that one key may hold most rows: positions are counted, cut into blocks of fixed
    width, and joined to runs inside each block. A run between the first and the last of its block
    touches no other block and is done; the first and the last of each block are joined afterwards, two
    rows per block however sparse the key is.
    Returns keys, run_start, run_end, n (rows, duplicates included), n_positions.
    """
    keys = list(keys)
    counted = points.groupBy(*keys, pos).agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.withColumn("_block", F.floor(F.col(pos) / block))
    local = _merge_runs(
        counted.select(
            *keys, "_block", F.col(pos).alias("run_start"), F.col(pos).alias("run_end"),
            F.col("_n").alias("n"), F.lit(1).cast("long").alias("n_positions"),
        ),
        [*keys, "_block"], max_gap,
    )
    block_of = W.partitionBy(*keys, "_block")
    edge = (F.col("run_start") == F.min("run_start").over(block_of)) | (F.col("run_start") == F.max("run_start").over(block_of))
    local = local.withColumn("_edge", edge)
    done = local.filter(~F.col("_edge")).drop("_block", "_edge")
    return done.unionByName(_merge_runs(local.filter("_edge").drop("_block", "_edge"), keys, max_gap))


def _merge_runs(pieces: DataFrame, keys: Sequence[str], max_gap: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy("run_start")
    opened = F.coalesce((F.col("run_start") - F.lag("run_end").over(w) > max_gap).cast("long"), F.lit(1))
    marked = pieces.withColumn("_open", opened).withColumn(
        "_run", F.sum("_open").over(w.rowsBetween(W.unboundedPreceding, 0))
    )
    return marked.groupBy(*keys, "_run").agg(
        F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"),
        F.sum("n").alias("n"), F.sum("n_positions").alias("n_positions"),
    ).drop("_run")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn") -> DataFrame:
    """1-based position in `order` within `keys`, without one task per key: the rows are range
    partitioned on (keys, order), fixed by a checkpoint, numbered inside each partition and shifted
    by the row counts of the partitions before (a table of partitions x keys touched)."""
    keys, order = list(keys), list(order)
    laid = df.repartitionByRange(*keys, *order).withColumn("_pid", F.spark_partition_id())
    laid = cut_lineage(laid)
    counts = laid.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy(*keys).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_pid", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy("_pid", *keys).orderBy(*order)
    return (
        laid.withColumn("_in", F.row_number().over(inside))
        .join(offsets, [*keys, "_pid"])
        .withColumn(name, (F.col("_in") + F.col("_off")).cast("long"))
        .drop("_in", "_off", "_pid")
    )


def rounded(c: Column | str, places: int) -> Column:
    """round() without a negative zero."""
    return F.round(c, places) + F.lit(0.0)


def pct(part: Column, whole: Column, places: int = 2) -> Column:
    """Share in percent; null where the whole is 0."""
    return F.when(whole != 0, F.round(part / whole * 100, places))


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The values of the row before, per key, as prev_*. Numbered rows joined to their predecessor,
    so that a hot key is spread over tasks."""
    ranked = numbered(df, keys, order, name="_rn")
    before = ranked.select(*keys, (F.col("_rn") + 1).alias("_rn"), *[F.col(c).alias(f"prev_{c}") for c in columns])
    return ranked.join(before, [*keys, "_rn"], "left").drop("_rn")

"""Log and report files: JSON record sets, dated logs, CSV export, catalog listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidspark.operators.logs import flat_export
from vidspark.schemas import COMPARISON, REJECTION


def read_records(spark: SparkSession, path: str, schema: str = COMPARISON, *, start: str | None = None, end: str | None = None, ids: list[str] | None = None, id: str = "comparison_id", ts: str = "timestamp", multi_line: bool = True) -> DataFrame:
    """JSON records of a folder; unreadable files and records are set aside, not fatal. The range is
    inclusive at both ends. `multi_line` off: one record per line, so that large files are split."""
    df = spark.read.schema(f"{schema}, _corrupt STRING").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", multiLine=multi_line)
    df = df.filter(F.col(id).isNotNull())
    if start:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end:
        df = df.filter(F.col(ts) <= F.lit(end).cast("timestamp"))
    return df.filter(F.col(id).isin(ids)) if ids else df


def append_dated(log: DataFrame, path: str, *, date: str = "date") -> None:
    """Append to a log partitioned by day. Rows of one day are spread over files by size, not by key."""
    log.write.mode("append").partitionBy(date).parquet(path)


def read_dated(spark: SparkSession, path: str, *, date: str | None = None, schema: str = REJECTION) -> DataFrame:
    """A dated log; with `date` only that partition is listed and read. The schema is stated."""
    df = spark.read.schema(schema).parquet(path)
    return df if date is None else df.filter(F.col("date") == F.lit(date).cast("date"))


def export_csv(log: DataFrame, path: str) -> None:
    flat_export(log).write.mode("overwrite").option("header", True).csv(path)


IMAGE_KINDS = ("jpg", "jpeg", "png", "webp", "JPG", "JPEG", "PNG", "WEBP")


def list_images(spark: SparkSession, path: str, *, content: bool = False, kinds: Sequence[str] = IMAGE_KINDS) -> DataFrame:
    """Image files (or files of other `kinds`) below a folder (flat or in batch_NNNN folders): path,
    filename, batch, time, size. Without `content` no file is opened."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(kinds)}}}").load(path)
    cols = [F.col("path"), F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.nullif(F.regexp_extract("path", r"/(?:batch=)?(batch_\d{4})/", 1), F.lit("")).alias("batch"), F.col("modificationTime").alias("stamp"), F.col("length").alias("bytes")]
    return df.select(*cols, *([F.col("content")] if content else []))


def write_report(report: DataFrame, path: str, *, run_id: str) -> None:
    """One folder per run; a run written twice replaces itself."""
    report.write.mode("overwrite").json(f"{path}/run_id={run_id}")


def read_latest_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the newest run: its id is a partition value, so the other runs are not read."""
    runs = spark.read.schema(f"{schema}, run_id STRING").json(path)
    latest = runs.agg(F.max("run_id").alias("run_id"))
    return runs.join(F.broadcast(latest), "run_id", "left_semi")  # one row

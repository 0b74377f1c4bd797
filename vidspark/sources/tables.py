"""Gallery, name list and catalog tables: loading, validating, appending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidspark.functions.names import person_from_path, strip
from vidspark.functions.vectors import valid_vector


def load_gallery(spark: SparkSession, path: str, *, domain: str | None = None) -> DataFrame:
    """Stored vectors with the person taken from the image path; empty vectors are left out. The
    domain filter reaches the scan (partition or column)."""
    return gallery_rows(spark.read.parquet(path), domain=domain)


def gallery_rows(df: DataFrame, *, domain: str | None = None, path: str = "image_path") -> DataFrame:
    kept = df if domain is None else df.filter(F.col("domain") == domain)
    return kept.filter(F.size("embedding") > 0).withColumn("person", person_from_path(F.col(path), "a"))


def split_valid(vectors: DataFrame, *, dim: int, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(insertable rows, quarantined rows with a reason) of a bulk vector load."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    reason = F.when(F.col("embedding").isNull(), "no_vector").when(~valid_vector(F.col("embedding"), dim), "wrong_dimension").when(missing, "missing_key")
    judged = vectors.withColumn("reject_reason", reason)
    return judged.filter("reject_reason IS NULL").drop("reject_reason"), judged.filter("reject_reason IS NOT NULL")


def bulk_insert(vectors: DataFrame, path: str, quarantine: str, *, dim: int, partition: str = "domain") -> None:
    """One distributed write; rows that cannot be inserted go to the quarantine table."""
    good, bad = split_valid(vectors, dim=dim)
    good.write.mode("append").partitionBy(partition).parquet(path)
    bad.write.mode("append").parquet(quarantine)


def append_names(existing: DataFrame, new: DataFrame, *, full: str) -> DataFrame:
    """Name list (name, last_name) with new full names split at the first space; one-word names are left out."""
    parts = F.split(strip(F.col(full)), " ", 2)
    split = new.select(parts.alias("p")).filter(F.size("p") >= 2).select(F.get("p", F.lit(0)).alias("name"), F.get("p", F.lit(1)).alias("last_name"))
    return existing.select("name", "last_name").unionByName(split)


def backfill_persons(folders: DataFrame, persons: DataFrame, name_map: DataFrame, *, folder: str = "folder") -> DataFrame:
    """Person rows for folders not yet known, named by the map or by the folder in title case."""
    missing = folders.select(folder, "domain").distinct().join(persons.select(folder, "domain"), [folder, "domain"], "left_anti")
    known = name_map.select(folder, F.col("original").alias("_o"))
    return missing.join(known, folder, "left").select(
        folder, "domain", F.coalesce("_o", F.initcap(F.translate(folder, "_", " "))).alias("name")
    )

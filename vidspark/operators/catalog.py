"""Statistics of galleries, domains and file catalogs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidspark.functions.names import person_from_path
from vidspark.operators.common import numbered, parameter_table, pct, with_group

# Upper bounds and labels of the count histogram.
COUNT_EDGES = ((1, "1"), (5, "2-5"), (10, "6-10"), (20, "11-20"), (50, "21-50"), (100, "51-100"), (200, "101-200"))
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")

# Model -> dollars per million prompt and completion tokens.
MODEL_PRICES = (
    ("gpt-4.1-mini", 0.40, 1.60),
    ("gpt-4.1", 2.00, 8.00),
    ("gpt-4o", 2.50, 10.00),
    ("gpt-4o-mini", 0.15, 0.60),
    ("gpt-5-mini", 0.25, 2.00),
    ("gpt-5", 1.25, 10.00),
    ("gemini-2.0-flash", 0.10, 0.40),
    ("gemini-2.5-flash", 0.15, 0.60),
    ("gemini-2.5-pro", 1.25, 5.00),
    ("gemini-3-flash-preview", 0.15, 0.60),
    ("gemini-3-pro-preview", 1.25, 5.00),
)


def vectors_per_person(persons: DataFrame, vectors: DataFrame, *, id: str = "person_id") -> DataFrame:
    """Every person with its number of vectors, zero included; vectors are counted before the join."""
    n = vectors.groupBy(id).agg(F.count(F.lit(1)).alias("n"))
    return persons.join(n, id, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def gallery_stats(persons: DataFrame, vectors: DataFrame, *, rollup: bool = True) -> DataFrame:
    """Persons, vectors and their ratio per domain and, as domain null, over all."""
    per = vectors_per_person(persons, vectors)
    g = per.rollup("domain") if rollup else per.groupBy("domain")
    out = g.agg(F.count(F.lit(1)).alias("persons"), F.sum("n").alias("vectors"))
    ratio = F.when(F.col("persons") > 0, F.round(F.col("vectors") / F.col("persons"), 1)).otherwise(0.0)
    return out.withColumn("vectors_per_person", ratio)


def domain_stats(people: DataFrame, images: DataFrame, batches: DataFrame) -> DataFrame:
    """One long table per domain: people by status, images by source, batches by status with the images
    their people had accepted. Batches hold an array of people."""

    def counted(df: DataFrame, kind: str, by: str, total: Column) -> DataFrame:
        return df.groupBy("domain", F.lit(kind).alias("kind"), F.col(by).alias("class")).agg(F.count(F.lit(1)).alias("n"), total.cast("long").alias("accepted"))

    none = F.max(F.lit(None).cast("long"))
    took = F.aggregate("people", F.lit(0).cast("long"), lambda s, p: s + F.coalesce(p["images_accepted"], F.lit(0)))
    return (
        counted(people, "people", "status", none).unionByName(counted(images, "images", "source", none))
        .unionByName(counted(batches.withColumn("_took", took), "batches", "status", F.sum("_took")))
    )


def catalog_stats(files: DataFrame, *, keys: Sequence[str] = ("domain",), rule: str = "d", stamp: str = "stamp", file: str = "filename", has_index: Column | None = None) -> DataFrame:
    """Photos, persons, bytes, images per person (mean, upper median, min, max), oldest and newest file,
    health score and warnings. Two levels: per person, then per domain over the person rows. The
    median is read off the distribution of counts, a table as short as the counts are distinct."""
    keys = list(keys)
    per = files.withColumn("person", person_from_path(F.col(file), rule)).groupBy(*keys, "person").agg(
        F.count(F.lit(1)).alias("images"), F.sum("bytes").alias("bytes"), F.min_by(F.struct(file, stamp), F.struct(stamp, file)).alias("_old"), F.max_by(F.struct(file, stamp), F.struct(stamp, file)).alias("_new")
    )
    g = per.groupBy(*keys).agg(
        F.sum("images").alias("photos"), F.count(F.lit(1)).alias("persons"), F.sum("bytes").alias("bytes"), F.avg("images").alias("avg_images"),
        F.min("images").alias("min_images"), F.max("images").alias("max_images"), F.count_if(F.col("images") < 5).alias("thin_persons"),
        F.min_by("_old", F.struct(f"_old.{stamp}", f"_old.{file}")).alias("_old"), F.max_by("_new", F.struct(f"_new.{stamp}", f"_new.{file}")).alias("_new"),
    )
    g = g.join(upper_median(per, keys, "images"), keys)
    indexed = F.lit(True) if has_index is None else has_index
    health = F.lit(100) - F.when(indexed, 0).otherwise(20) - F.when(F.col("persons") == 0, 50).otherwise(0) - F.least(F.lit(20), F.col("thin_persons"))
    warnings = F.array_compact(F.array(
        F.when(~indexed, "no index file"), F.when(F.col("persons") == 0, "no persons"),
        F.when(F.col("thin_persons") > 0, F.concat(F.col("thin_persons"), F.lit(" persons have fewer than 5 images"))),
    ))
    return g.select(
        *keys, "photos", "persons", "bytes", "avg_images", "median_images", "min_images", "max_images", F.col(f"_old.{file}").alias("oldest"), F.col(f"_new.{file}").alias("newest"),
        health.cast("long").alias("health"), warnings.alias("warnings"),
    )


def upper_median(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """sorted[n // 2] per key, from the counts of the distinct values."""
    from pyspark.sql import Window as W

    dist = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    below = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    placed = dist.withColumn("_upto", F.sum("_c").over(below)).withColumn("_all", F.sum("_c").over(W.partitionBy(*keys)))
    hit = placed.filter(F.col("_upto") > F.floor(F.col("_all") / 2))
    return hit.groupBy(*keys).agg(F.min(value).alias(f"median_{value}"))


def file_types(files: DataFrame, *, keys: Sequence[str] = ("domain",), file: str = "filename") -> DataFrame:
    ext = F.lower(F.regexp_extract(F.col(file), r"(\.[^.]*)$", 1))
    n = files.groupBy(*keys, ext.alias("extension")).agg(F.count(F.lit(1)).alias("files"))
    return with_group(n, list(keys), F.sum("files").alias("_all")).withColumn("share", pct(F.col("files"), F.col("_all"), 1)).drop("_all")


def images_per_person(files: DataFrame, *, keys: Sequence[str] = ("domain",), rule: str = "d", file: str = "filename") -> DataFrame:
    return files.withColumn("person", person_from_path(F.col(file), rule)).groupBy(*keys, "person").agg(F.count(F.lit(1)).alias("images"), F.sum("bytes").alias("bytes"))


def count_histogram(per_person: DataFrame, *, keys: Sequence[str] = ("domain",), value: str = "images", edges=COUNT_EDGES) -> DataFrame:
    """Persons per count class with their share."""
    label = F.lit(f"{edges[-1][0]}+")
    for top, name in reversed(edges):
        label = F.when(F.col(value) <= top, name).otherwise(label)
    n = per_person.groupBy(*keys, label.alias("class")).agg(F.count(F.lit(1)).alias("persons"))
    return with_group(n, list(keys), F.sum("persons").alias("_all")).withColumn("share", pct(F.col("persons"), F.col("_all"), 1)).drop("_all")


def storage_totals(files: DataFrame, *, rule: str = "d", file: str = "filename") -> DataFrame:
    """Photos, persons and bytes for every combination of storage and domain, totals included."""
    per = files.withColumn("person", person_from_path(F.col(file), rule)).groupBy("storage", "domain", "person").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    return per.cube("storage", "domain").agg(F.sum("n").alias("photos"), F.countDistinct("person").alias("persons"), F.sum("b").alias("bytes"))


def person_locations(files: DataFrame, *, rule: str = "d", file: str = "filename") -> DataFrame:
    """Total per person and the storages it is found in (as many as there are storages)."""
    per = files.withColumn("person", person_from_path(F.col(file), rule)).groupBy("person", "storage").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("person").agg(F.sum("n").alias("images"), F.array_sort(F.collect_set("storage")).alias("storages"))


def top_and_bottom(per_person: DataFrame, *, n: int, value: str = "images") -> DataFrame:
    """The n persons with most and the n with fewest images: two distributed top-n."""
    top = per_person.orderBy(F.col(value).desc(), "person").limit(n).withColumn("side", F.lit("top"))
    return top.unionByName(per_person.orderBy(value, "person").limit(n).withColumn("side", F.lit("bottom")))


def images_of_person(a: DataFrame, b: DataFrame, *, file: str = "filename", day: bool = True, strict_reference: str | None = None) -> DataFrame:
    """Images per person (and date) over two stores. `strict_reference` counts, for that one name, every
    file that contains it, so that a short name also counts longer ones."""
    from vidspark.functions.names import date_from_path

    both = a.select(file).unionByName(b.select(file))
    if strict_reference is not None:
        return both.filter(F.contains(F.col(file), F.lit(strict_reference))).agg(F.lit(strict_reference).alias("person"), F.count(F.lit(1)).alias("images"))
    keyed = both.withColumn("person", person_from_path(F.col(file), "d")).withColumn("day", date_from_path(F.col(file)))
    return keyed.groupBy("person", *(["day"] if day else [])).agg(F.count(F.lit(1)).alias("images"))


def reconcile(files: DataFrame, vectors: DataFrame, *, keys: Sequence[str] = ("domain", "filename")) -> DataFrame:
    """Files with and without a vector, and vectors without a file, per domain."""
    f = files.select(*keys).distinct().withColumn("_f", F.lit(True))
    v = vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("_v"))
    j = f.join(v, list(keys), "full_outer")
    return j.groupBy(keys[0]).agg(
        F.count("_f").alias("files"), F.coalesce(F.sum("_v"), F.lit(0)).alias("vectors"), F.count_if(F.col("_f") & F.col("_v").isNotNull()).alias("files_with_vector"),
        F.count_if(F.col("_f") & F.col("_v").isNull()).alias("files_without_vector"), F.count_if(F.col("_f").isNull()).alias("orphan_vectors"),
    )


def batch_numbers(files: DataFrame, *, keys: Sequence[str] = ("domain",), file: str = "filename", size: int = 5000) -> DataFrame:
    """Fixed-size batches over the sorted names of each domain."""
    ranked = numbered(files, keys, [file], name="_n")
    return ranked.withColumn("batch", F.format_string("batch_%04d", F.floor((F.col("_n") - 1) / size) + 1)).drop("_n")


def processing_status(batches: DataFrame, *, today: str) -> DataFrame:
    """Queued, processed and failed people, from the people rows of the batches."""
    p = batches.select("status", F.to_date("created_at").alias("day"), F.explode("people").alias("p"))
    is_today = F.col("day") == F.lit(today).cast("date")
    return p.agg(
        F.count_if(F.col("status") == "pending").alias("total_in_queue"), F.count_if((F.col("status") == "completed") & is_today & (F.col("p.status") == "success")).alias("processed_today"),
        F.count_if((F.col("status") == "failed") & is_today).alias("failed_today"), F.count_if(F.col("status") == "pending").alias("remaining"),
    )


def storage_usage(files: DataFrame, *, by: str, size: str) -> DataFrame:
    return files.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.round(F.sum(size) / 1048576, 2).alias("megabytes"))


def token_cost(usage: DataFrame, *, prices=MODEL_PRICES) -> DataFrame:
    """Tokens and dollars per model; unknown models cost nothing."""
    p = parameter_table(usage.sparkSession, prices, "model string, _in double, _out double")
    priced = usage.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens")).join(p, "model", "left")
    cost = F.col("prompt_tokens") / 1e6 * F.coalesce("_in", F.lit(0.0)) + F.col("completion_tokens") / 1e6 * F.coalesce("_out", F.lit(0.0))
    return priced.withColumn("cost", F.round(cost, 6)).drop("_in", "_out")


def duplicate_ids(df: DataFrame, *, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")

"""Recognition and rejection logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidspark.operators.common import pct


def log_summary(log: DataFrame, *, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Photos, recognised photos, rate, distinct persons and mean confidence per batch. The persons
    themselves are rows of `log_persons`."""
    seen = F.col("recognized")
    n, r = F.count(F.lit(1)), F.count_if(seen)
    return log.groupBy(*by).agg(
        n.alias("total_photos"), r.alias("recognized_count"), (n - r).alias("unrecognized_count"), F.coalesce(pct(r, n), F.lit(0.0)).alias("recognition_rate"),
        F.countDistinct(F.when(seen, F.col("person"))).alias("unique_persons"), F.coalesce(F.round(F.avg(F.when(seen, F.col("confidence"))), 2), F.lit(0.0)).alias("avg_confidence"),
    )


def log_persons(log: DataFrame, *, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    return log.filter(F.col("recognized") & F.col("person").isNotNull()).select(*by, "person").distinct()


def recent_batches(log: DataFrame, *, n: int = 50) -> DataFrame:
    """Newest batches first, with their summary; the batches are chosen before they are summarised."""
    newest = log.groupBy("batch_id").agg(F.max("ts").alias("last_ts")).orderBy(F.col("last_ts").desc(), "batch_id").limit(n)
    return newest.join(log_summary(log.join(newest.select("batch_id"), "batch_id", "left_semi")), "batch_id").orderBy(F.col("last_ts").desc(), "batch_id")


def rejection_summary(log: DataFrame, *, date: str | None = None, person: str | None = None) -> DataFrame:
    """Rejections by reason, by person and in total, in one pass. `date` prunes partitions."""
    if date is not None:
        log = log.filter(F.col("date") == F.lit(date))
    if person is not None:
        log = log.filter(F.col("person") == person)
    named = log.select(F.coalesce("reason", F.lit("unknown")).alias("reason"), F.coalesce("person", F.lit("unknown")).alias("person"))
    return named.groupingSets([["reason"], ["person"], []], "reason", "person").agg(F.count(F.lit(1)).alias("rejections"), F.grouping_id().alias("level"))


def reason_histogram(log: DataFrame, *, by: Sequence[str] = (), reason: str = "reason") -> DataFrame:
    return log.filter(F.col(reason).isNotNull()).groupBy(*by, reason).agg(F.count(F.lit(1)).alias("n"))


def session_counters(results: DataFrame, *, session: str, success: Column) -> DataFrame:
    return results.groupBy(session).agg(F.count(F.lit(1)).alias("total"), F.count_if(success).alias("successes"), F.count_if(~success).alias("failures"))


def flat_export(log: DataFrame) -> DataFrame:
    """One flat row per photo, the top three matches as fixed columns padded with null."""
    cols = [F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "filename", "domain", F.when(F.col("recognized"), "Yes").otherwise("No").alias("recognized"), F.col("person").alias("primary_person"), F.col("confidence").alias("primary_confidence")]
    for i in range(3):
        m = F.get("top_matches", F.lit(i))
        cols += [m["person"].alias(f"match_{i + 1}_person"), m["confidence"].alias(f"match_{i + 1}_confidence")]
    return log.select(*cols, "face_count", "processing_time_ms")


def page(df: DataFrame, *, order: Sequence[str | Column], number: int, size: int, cap: int = 100) -> DataFrame:
    """One page in order, with the total number of rows. Pages of more than `cap` rows are refused: the
    offset passes through one task, so it is for the first pages; `page_after` reads on from any place."""
    if not 1 <= size <= cap:
        raise ValueError(f"page size {size}; 1 to {cap} are supported")
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return df.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total", total)


def page_after(df: DataFrame, *, key: str, after: object | None, size: int) -> DataFrame:
    """The next `size` rows by a unique key behind the last one seen: a filter and a distributed top-n."""
    rest = df if after is None else df.filter(F.col(key) > F.lit(after))
    return rest.orderBy(key).limit(size)


def newest_dates(log: DataFrame, *, date: str = "date", n: int = 30) -> DataFrame:
    """Newest valid date partitions."""
    parsed = F.try_to_timestamp(F.col(date), F.lit("yyyy-MM-dd")).cast("date")
    return log.select(date).distinct().filter(parsed.isNotNull()).orderBy(F.col(date).desc()).limit(n)


def concat_shards(*shards: DataFrame) -> DataFrame:
    """Results of several shards as one table."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    return out


def first_source_wins(sources: Sequence[tuple[str, DataFrame]], *, name: str = "name") -> DataFrame:
    """Union of sources in order of precedence; per lower-case name the first source (then the lowest
    name) stays."""
    tagged = [df.withColumn("source", F.lit(label)).withColumn("_rank", F.lit(i)) for i, (label, df) in enumerate(sources)]
    both = concat_shards(*tagged)
    cols = [c for c in both.columns if c != "_rank"]
    low = F.lower(F.trim(F.col(name)))
    return both.groupBy(low.alias("_key")).agg(F.min_by(F.struct(*cols), F.struct("_rank", *cols)).alias("_r")).select("_r.*")


def drop_known_content(new: DataFrame, existing: DataFrame, *, digest: str, order: str) -> DataFrame:
    """Rows whose content is neither stored already nor earlier in the input."""
    fresh = new.join(existing.select(digest).distinct(), digest, "left_anti")
    rest = [c for c in new.columns if c != digest]
    return fresh.groupBy(digest).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(digest, "_r.*")


def average_hash(pixels: Column) -> Column:
    """64 bits of an 8 x 8 grey image: 1 where a pixel is above the mean."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x) / F.size(pixels)
    return F.array_join(F.transform(pixels, lambda p: F.when(p > mean, "1").otherwise("0")), "")


def first_per_hash(images: DataFrame, *, pixels: str = "pixels", order: str = "seq", keys: Sequence[str] = ()) -> DataFrame:
    rest = [c for c in images.columns if c not in (pixels, *keys)]
    hashed = images.withColumn("hash", average_hash(F.col(pixels)))
    return hashed.groupBy(*keys, "hash").agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"), F.count(F.lit(1)).alias("copies")).select(*keys, "hash", "_r.*", "copies")

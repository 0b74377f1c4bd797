"""A keyed snapshot kept up to date by a stream, in buckets under a manifest.

Rows live in `buckets` buckets by the hash of their keys. A batch rewrites only the buckets that its changes
fall into, beside the old ones, and then commits a manifest, one small file that names the commit each bucket
was last written by, and the stream's checkpoint and batch. A repeated batch finds itself in the manifest
and does nothing; an interrupted one leaves files that no manifest names and is written again. A fresh
checkpoint over an old folder goes on from its newest commit. Commits older than the last `keep` expire,
with the files that only they name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vidspark.operators.workflow import upsert

BUCKETS, KEEP = 64, 3


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def commits(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the commits there are, oldest first."""
    fs, at = _folder(spark, f"{root}/manifest")
    if not fs.exists(at):
        return []
    found = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("commit=")]
    done = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def _manifest(spark: SparkSession, root: str, commit: int) -> list:
    """Rows (bucket, written) and (source, batch) of a commit: one per bucket and per stream."""
    return spark.read.parquet(f"{root}/manifest/commit={commit}").collect()


def _paths(root: str, rows: list) -> list[str]:
    return [f"{root}/rows/commit={r['written']}/bucket={r['bucket']}" for r in rows if r["bucket"] is not None]


def read_snapshot(spark: SparkSession, root: str, schema: str, commit: int | None = None) -> DataFrame:
    """The table as of a commit, by default the newest."""
    known = commits(spark, root)
    if not known:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*_paths(root, _manifest(spark, root, commit or known[-1])))


def _expire(spark: SparkSession, root: str, keep: int) -> None:
    known = commits(spark, root)
    for commit in known[:-keep]:
        fs, at = _folder(spark, f"{root}/manifest/commit={commit}")
        fs.delete(at, True)
    named = {p for commit in known[-keep:] for p in _paths(root, _manifest(spark, root, commit))}
    for commit in (c for c in range(1, known[-1] + 1)):
        fs, at = _folder(spark, f"{root}/rows/commit={commit}")
        if not fs.exists(at):
            continue
        held = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("bucket=")]
        stale = [p for p in held if f"{root}/rows/commit={commit}/{p.getName()}" not in named]
        for p in stale:
            fs.delete(p, True)
        if len(stale) == len(held):
            fs.delete(at, True)


def merge_batch(
    batch: DataFrame, root: str, *, source: str, batch_id: int, keys: Sequence[str], schema: str, mode: str = "coalesce", order: str | None = None, buckets: int = BUCKETS, keep: int = KEEP,
) -> int:
    """Merge changes into the snapshot under `root`; how many buckets were written."""
    spark = batch.sparkSession
    known = commits(spark, root)
    old = _manifest(spark, root, known[-1]) if known else []
    if any(r["source"] == source and r["batch"] >= batch_id for r in old if r["bucket"] is None):
        return 0
    bucketed = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
    touched = [r["bucket"] for r in bucketed.select("bucket").distinct().collect()]  # at most `buckets`
    if not touched:
        return 0
    commit = known[-1] + 1 if known else 1
    before = [r for r in old if r["bucket"] in set(touched)]
    rows = spark.read.schema(schema).parquet(*_paths(root, before)) if before else spark.createDataFrame([], schema)
    merged = upsert(rows, bucketed.drop("bucket"), keys=keys, mode=mode, order=order)
    merged = merged.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).repartition("bucket")
    merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/rows/commit={commit}")
    rest = [(r["bucket"], r["written"], r["source"], r["batch"]) for r in old if r["bucket"] not in touched and r["source"] != source]
    rows = rest + [(b, commit, None, None) for b in touched] + [(None, None, source, batch_id)]
    table = spark.createDataFrame(rows, "bucket int, written long, source string, batch long")
    table.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/commit={commit}")
    bucketed.unpersist()
    _expire(spark, root, keep)
    return len(touched)


def upsert_stream(
    changes: DataFrame, root: str, checkpoint: str, *, keys: Sequence[str], schema: str, mode: str = "coalesce", order: str | None = None, buckets: int = BUCKETS, keep: int = KEEP,
) -> StreamingQuery:
    """Snapshot of `schema` under `root`, merged batch by batch. `root` and `checkpoint` are folders that all
    executors share."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, root, source=checkpoint, batch_id=batch_id, keys=keys, schema=schema, mode=mode, order=order, buckets=buckets, keep=keep)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructField, StructType

from vidspark.operators.compare import comparison_summary
from vidspark.operators.index import VectorIndex, search_index


def match_stream(probes: DataFrame, index: VectorIndex, out: str, checkpoint: str, **search) -> StreamingQuery:
    """Arriving probes against a stored index. Its cells and centroids were made once; a batch reads the
    cells that it visits and counts nothing of the gallery. Each batch writes its own folder, so that a
    repeated batch replaces itself."""

    def match(batch: DataFrame, batch_id: int) -> None:
        search_index(index, batch, **search).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return probes.writeStream.foreachBatch(match).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def marked(stream: DataFrame, *, ts: str, delay: str, key: str) -> DataFrame:
    """`stream` with its watermark. Rows without a key only move the watermark on (`flush_row`); they are
    dropped behind it."""
    return stream.withWatermark(ts, delay).filter(F.col(key).isNotNull() | F.col(ts).isNull())


def with_control(stream: DataFrame, folder: str) -> DataFrame:
    """`stream` and the flush rows that arrive in `folder`."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def flush_row(spark: SparkSession, folder: str, schema: StructType, *, ts: str, at: datetime, **values) -> None:
    """One row with nothing but a time of `at` (and `values`: a stream-stream join drops null keys before the
    watermark sees them, so it takes a key that nothing else has): the next run of a stream that reads the folder emits all that
    the watermark then lies behind, whatever its keys. For the end of a stream; what arrives behind it is late."""
    row = tuple(at if f.name == ts else values.get(f.name) for f in schema.fields)
    loose = StructType([StructField(f.name, f.dataType, True) for f in schema.fields])
    spark.createDataFrame([row], loose).coalesce(1).write.mode("append").parquet(folder)


def presence_sessions(frames: DataFrame, *, keys: Sequence[str], ts: str, gap: str, delay: str) -> DataFrame:
    """Runs of sightings whose neighbours are less than `gap` apart. In append mode a session comes out once,
    when the watermark has passed it, and leaves the state."""
    return marked(frames, ts=ts, delay=delay, key=keys[0]).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n")
    ).drop("w")


def windowed_summary(cmp: DataFrame, *, ts: str = "ts", delay: str = "1 day", width: str = "1 day", slide: str | None = None, key: str = "image_id") -> DataFrame:
    """Tumbling or sliding comparison metrics; in append mode each window comes out once and leaves the state."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return comparison_summary(marked(cmp, ts=ts, delay=delay, key=key), by=[w.alias("window")])


class Resting(StatefulProcessor):
    """State per key that goes when nothing arrived for the key within `rest_ms` of event time."""

    def __init__(self, ts: str, rest_ms: int):
        self.ts, self.rest_ms = ts, rest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "ms LONG")

    def rest_after(self, batch: pd.DataFrame) -> None:
        """Notes the newest time of a key; a later time moves its end on."""
        ms = int(batch[self.ts].astype("datetime64[us]").astype("int64").max() // 1000)
        if not self.seen.exists() or ms > self.seen.get()[0]:
            self.seen.update((ms,))
            self.handle.registerTimer(ms + self.rest_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists() and self.seen.get()[0] + self.rest_ms <= timerValues.getCurrentWatermarkInMs():
            self.seen.clear()
            self.forget()
        yield from ()

    def forget(self) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


class LogSums(Resting):
    """Per batch of a log: rows, recognised ones, their confidence and persons. Every update gives the new sums."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.sums = handle.getValueState("sums", "n LONG, r LONG, c DOUBLE")
        self.persons = handle.getMapState("persons", "person STRING", "n LONG")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, r, c = self.sums.get() if self.sums.exists() else (0, 0, 0.0)
        for b in rows:
            self.rest_after(b)
            seen = b[b["recognized"].fillna(False).astype(bool)]
            n, r, c = n + len(b), r + len(seen), c + float(seen["confidence"].fillna(0).sum())
            for person in seen["person"].dropna().unique():
                self.persons.updateValue((person,), (1,))
        self.sums.update((n, r, c))
        persons = sum(1 for _ in self.persons.keys())
        yield pd.DataFrame({"batch_id": [key[0]], "total_photos": [n], "recognized_count": [r], "recognition_rate": [r / n * 100], "persons": [persons], "avg_confidence": [c / r if r else None]})

    def forget(self) -> None:
        self.sums.clear()
        self.persons.clear()


class LatestStage(Resting):
    """Per key the stage with the newest time; every change is given out."""

    def __init__(self, key: str, ts: str, stage: str, rest_ms: int):
        super().__init__(ts, rest_ms)
        self.key, self.stage = key, stage

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.newest = handle.getValueState("newest", "us LONG, stage STRING")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.newest.get() if self.newest.exists() else None
        best = old
        for b in rows:
            self.rest_after(b)
            us = b[self.ts].astype("datetime64[us]").astype("int64")
            at = int(us.to_numpy().argmax())
            if best is None or int(us.iloc[at]) > best[0]:
                best = (int(us.iloc[at]), b[self.stage].iloc[at])
        if best != old:
            self.newest.update(best)
            yield pd.DataFrame({self.key: [key[0]], self.stage: [best[1]], "us": [best[0]]})

    def forget(self) -> None:
        self.newest.clear()


def running_log_summary(log: DataFrame, *, ts: str = "ts", delay: str = "1 hour", rest_hours: int = 48) -> DataFrame:
    """Running batch summary as updates: the row of a batch with most photos holds. The rate is not rounded.
    A batch at rest leaves the state. Needs the RocksDB state store provider."""
    kind = f"batch_id {log.schema['batch_id'].dataType.simpleString()}, total_photos LONG, recognized_count LONG, recognition_rate DOUBLE, persons LONG, avg_confidence DOUBLE"
    rows = log.select("batch_id", ts, "recognized", "confidence", "person")
    return marked(rows, ts=ts, delay=delay, key="batch_id").groupBy("batch_id").transformWithStateInPandas(
        statefulProcessor=LogSums(ts, rest_hours * 3_600_000), outputStructType=kind, outputMode="Update", timeMode="EventTime"
    )


def unique_content(files: DataFrame, *, digest: str, ts: str, delay: str) -> DataFrame:
    """First arrival per content hash; the state of a hash is kept for `delay`."""
    return files.withWatermark(ts, delay).dropDuplicatesWithinWatermark([digest])


def stage_pairs(started: DataFrame, finished: DataFrame, *, key: str, ts: str, within: str, delay: str, how: str = "leftOuter") -> DataFrame:
    """Stage events joined to their completion: a stream-stream join bounded by event time, so that its
    state can be dropped. Unfinished ones appear once the watermark has passed."""
    s = marked(started, ts=ts, delay=delay, key=key).select(F.col(key), F.col(ts).alias("started_at"))
    f = marked(finished, ts=ts, delay=delay, key=key).select(F.col(key).alias("_k"), F.col(ts).alias("finished_at"))
    in_time = (F.col("finished_at") >= F.col("started_at")) & (F.col("finished_at") <= F.col("started_at") + F.expr(f"INTERVAL {within}"))
    return s.join(f, (F.col(key) == F.col("_k")) & in_time, how).drop("_k")


def latest_stage(events: DataFrame, *, key: str, ts: str, stage: str, delay: str = "1 hour", rest_hours: int = 48) -> DataFrame:
    """Newest stage per key as updates; the row with the newest time holds. A key at rest leaves the state.
    Needs the RocksDB state store provider."""
    kind = f"{key} {events.schema[key].dataType.simpleString()}, {stage} STRING, us LONG"
    changes = marked(events.select(key, ts, stage), ts=ts, delay=delay, key=key).groupBy(key).transformWithStateInPandas(
        statefulProcessor=LatestStage(key, ts, stage, rest_hours * 3_600_000), outputStructType=kind, outputMode="Update", timeMode="EventTime"
    )
    return changes.select(key, stage, F.timestamp_micros("us").alias(ts))


def write_updates(result: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Updates of a stateful stream, one folder per batch, so that a repeated batch replaces itself."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return result.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_and_kept(stream: DataFrame, out: str, checkpoint: str, *, ts: str, delay_seconds: int) -> StreamingQuery:
    """Every row with whether it is late: behind the newest time of the batches before its own by more than
    the delay. Late rows are written beside the others, not only counted. The newest time is kept with each
    batch, so a repeated batch decides as before."""
    spark = stream.sparkSession

    def split(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        mark = spark.read.parquet(f"{out}/marks/batch={batch_id - 1}").first()["newest"] if batch_id else None
        late = F.lit(False) if mark is None else F.coalesce(F.unix_micros(ts) < F.lit(mark - delay_seconds * 1_000_000), F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(f"{out}/rows/batch={batch_id}")
        newest = F.greatest(F.max(F.unix_micros(ts)), F.lit(mark).cast("long")).alias("newest")
        batch.agg(newest).write.mode("overwrite").parquet(f"{out}/marks/batch={batch_id}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_append(result: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return result.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_log(log: DataFrame, out: str, checkpoint: str, *, date: str = "date") -> StreamingQuery:
    """Exactly-once append to a log partitioned by day."""
    return log.writeStream.outputMode("append").format("parquet").partitionBy(date).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that arrived behind the watermark and were dropped."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


def finish(query: StreamingQuery, timeout: int | None = None) -> StreamingQuery:
    """Wait for an availableNow query, which ends by itself however long its input is; raise what it raised."""
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError("stream did not finish")
    return query

"""Streams over the given tables, run to their end and compared with their batch twins."""

from contextlib import contextmanager
from datetime import datetime
from uuid import uuid4

from pyspark.sql import functions as F

from vidspark.checks.compare import CMP
from vidspark.checks import tracks as _tracks  # noqa: F401  registers the batch form first
from vidspark.checks.registry import ORACLES, query
from vidspark.checks.vectors import PAIRS
from vidspark.checks.views import DOMAIN, EVENT_INDEX, VIEWS, _dialect, table, view
from vidspark.operators.common import latest_per_key, rounded
from vidspark.operators.compare import comparison_metrics
from vidspark.operators.index import build_index
from vidspark.session import checkpoint_root
from vidspark.streaming import incremental as I
from vidspark.streaming.snapshot import read_snapshot, upsert_stream
from vidspark.streaming.tracker import track_stream


def source(spark, sf, name):
    """One table as a stream, whether it is one file of the folder or a folder of its own."""
    found = table(spark, sf, name)
    stream = spark.readStream.schema(found.schema)
    if any(f.endswith(f"/{name}.parquet") for f in found.inputFiles()):
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf)
    return stream.parquet(f"{sf}/{name}.parquet")


def folders(spark):
    root = f"{checkpoint_root(spark)}/streams/{uuid4().hex}"
    return f"{root}/out", f"{root}/checkpoint"


@contextmanager
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def to_the_end(spark, build, schemas, out, cp, values=None):
    """A stream in append mode, run over what there is, and once more behind a flush row in each control folder."""
    for _ in range(2):
        I.finish(I.write_append(build(), out, cp))
        for folder, schema in schemas.items():
            I.flush_row(spark, folder, schema, ts="ts", at=datetime(2100, 1, 1), **(values or {}).get(folder, {}))


@query("stream_matches", f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY d, vec_id) AS rank FROM pairs WHERE d < 0.85)
    SELECT probe_id, rank, vec_id, round(d, 6) + 0.0 AS distance FROM r WHERE rank <= 3""", ("gallery", "probes"))
def stream_matches(spark, sf):
    out, cp = folders(spark)
    probes = source(spark, sf, "embeddings").select(F.col("vec_id").alias("probe_id"), F.expr(DOMAIN.format("label")).alias("domain"), "embedding")
    index = build_index(view(spark, sf, "gallery"), f"{out}-index", cells=16, carry=())
    I.finish(I.match_stream(probes, index, out, cp, k=3, threshold=0.85, nprobe=index.cells))
    return spark.read.parquet(out).select("probe_id", F.col("rank").cast("long").alias("rank"), "vec_id", rounded("distance", 6).alias("distance"))


def stream_detections(spark, sf):
    e = source(spark, sf, "events")
    slot, k = F.expr(EVENT_INDEX), F.col("event_id")
    x, y = (slot * 120 + k % 11).cast("double"), (slot * 30 + k % 7).cast("double")
    hour = F.expr(_dialect("[HOURS]", spark=True))
    return e.select(F.col("user_id").alias("video_id"), F.col("ts").cast("timestamp").alias("ts"), hour.alias("frame_number"), k.alias("det_id"), x.alias("x1"), y.alias("y1"), (x + 100).alias("x2"), (y + 100).alias("y2"))


@query("stream_tracks")
def stream_tracks(spark, sf):
    """Videos without an end: one flush row for the whole stream brings out the last detections."""
    out, cp = folders(spark)
    dets, folder = stream_detections(spark, sf), f"{out}-control"
    with rocksdb(spark):
        to_the_end(spark, lambda: track_stream(I.with_control(dets, folder), delay="1 hour"), {folder: dets.schema}, out, cp)
    return spark.read.parquet(out)


@query("stream_tracks_closed", ORACLES["track_per_slot"])
def stream_tracks_closed(spark, sf):
    """One detection per slot and frame, then the end of each video: every row comes out, none waits."""
    out, cp = folders(spark)
    d = view(spark, sf, "single_detections").select("video_id", "frame_number", "det_id", "x1", "y1", "x2", "y2")
    stamp = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("frame_number") * 43_200)
    last = d.agg((F.max("frame_number") + 1).alias("f"))
    ends = d.select("video_id").distinct().join(F.broadcast(last)).select("video_id", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("f") * 43_200).alias("ts"))
    rows = d.withColumn("ts", stamp).unionByName(ends, allowMissingColumns=True)
    rows.write.parquet(f"{out}-source")
    stream = spark.readStream.schema(rows.schema).parquet(f"{out}-source")
    with rocksdb(spark):
        I.finish(I.write_append(track_stream(stream, delay="1 hour", frame_step=1), out, cp))
    return spark.read.parquet(out)


@query("stream_sessions", """WITH o AS (SELECT user_id, event_type, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) < INTERVAL 40 HOUR THEN 0 ELSE 1 END AS o FROM events),
    s AS (SELECT *, sum(o) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM o)
    SELECT user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, count(*) AS n FROM s GROUP BY user_id, event_type, run""")
def stream_sessions(spark, sf):
    out, cp = folders(spark)
    e = source(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = f"{out}-control"
    to_the_end(spark, lambda: I.presence_sessions(I.with_control(e, folder), keys=["user_id", "event_type"], ts="ts", gap="40 hours", delay="1 day"), {folder: e.schema}, out, cp)
    stamp = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_ts", "last_ts")]
    return spark.read.parquet(out).select("user_id", "event_type", *stamp, "n")


COMPARED = CMP.replace("(SELECT * FROM runs_a WHERE status <> 'no_match' OR confidence > 60) a FULL OUTER JOIN", "runs_a a JOIN")
METRICS = "count(*) AS total, count(*) FILTER (both_succeeded) AS both_succeeded, count(*) FILTER (results_match) AS agreements, count(*) FILTER (a_correct) AS a_right, count(*) FILTER (faster = 'pipeline_b') AS b_faster"


def _windows(spark, sf, **window):
    out, cp = folders(spark)
    runs_a = spark.sql(_dialect(VIEWS["runs_a"], spark=True).replace("FROM orders", "FROM {orders}"), orders=source(spark, sf, "orders"))
    runs_a = runs_a.withColumn("ts", F.col("ts").cast("timestamp"))
    folder = f"{out}-control"

    def build():
        # a flush row meets no run of the other pipeline: it must stay, to move the watermark on
        b = view(spark, sf, "runs_b").select("image_id", *[F.col(c).alias(f"{c}_b") for c in ("status", "person", "confidence", "seconds")], F.lit(True).alias("_met"))
        a = I.with_control(runs_a, folder).select("image_id", "ts", "ground_truth", *[F.col(c).alias(f"{c}_a") for c in ("status", "person", "confidence", "seconds")])
        joined = a.join(b, "image_id", "left").filter("_met OR image_id IS NULL")
        return I.windowed_summary(joined.select("*", *comparison_metrics()), **window)

    to_the_end(spark, build, {folder: runs_a.schema}, out, cp)
    return spark.read.parquet(out).select(
        F.date_format("window.start", "yyyy-MM-dd").alias("day"), "total", "both_succeeded", "agreements",
        F.round(F.coalesce(F.col("accuracy_a"), F.lit(0.0)) * F.col("with_truth") / 100).cast("long").alias("a_right"), "b_faster")


@query("stream_daily_summary", f"""WITH {COMPARED} SELECT strftime(ts, '%Y-%m-%d') AS day, {METRICS} FROM m GROUP BY 1""", ("runs_a", "runs_b"))
def stream_daily_summary(spark, sf):
    return _windows(spark, sf)


@query("stream_sliding_summary", f"""WITH {COMPARED} SELECT strftime(CAST(ts AS DATE) - back, '%Y-%m-%d') AS day, {METRICS} FROM m, (SELECT unnest([0, 1, 2]) AS back) d GROUP BY 1""", ("runs_a", "runs_b"))
def stream_sliding_summary(spark, sf):
    """Windows of three days, one day apart."""
    return _windows(spark, sf, width="3 days", slide="1 day")


@query("stream_log_summary", "SELECT batch_id, count(*) AS total_photos, count(*) FILTER (recognized) AS recognized_count, round(count(*) FILTER (recognized) / count(*) * 100, 2) AS recognition_rate, count(DISTINCT person) FILTER (recognized) AS persons FROM rec_log GROUP BY 1", ("rec_log",))
def stream_log_summary(spark, sf):
    out, cp = folders(spark)
    log = spark.sql(_dialect(VIEWS["rec_log"], spark=True).replace("FROM lineitem", "FROM {lineitem}"), lineitem=source(spark, sf, "lineitem"))
    with rocksdb(spark):
        I.finish(I.write_updates(I.running_log_summary(log), out, cp))
    newest = latest_per_key(spark.read.parquet(out).drop("batch"), ["batch_id"], ["total_photos"])
    return newest.select("batch_id", "total_photos", "recognized_count", F.round("recognition_rate", 2).alias("recognition_rate"), "persons")


@query("stream_upsert", "SELECT user_id, arg_max(event_type, event_id) AS last_type, arg_max(round(value, 2), event_id) FILTER (value > 50) AS last_large FROM events GROUP BY 1")
def stream_upsert(spark, sf):
    out, cp = folders(spark)
    e = source(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("last_type"), F.when(F.col("value") > 50, F.round("value", 2)).alias("last_large"))
    schema = "user_id LONG, last_type STRING, last_large DOUBLE"
    I.finish(upsert_stream(e, out, cp, keys=["user_id"], schema=schema, order="event_id"))
    return read_snapshot(spark, out, schema)


@query("stream_unique", "SELECT DISTINCT user_id, event_type FROM events")
def stream_unique(spark, sf):
    out, cp = folders(spark)
    e = source(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.md5(F.concat_ws("|", "user_id", "event_type").cast("binary")).alias("digest"))
    I.finish(I.write_append(I.unique_content(e, digest="digest", ts="ts", delay="60 days"), out, cp))
    return spark.read.parquet(out).select("user_id", "event_type")


@query("stream_stages", """SELECT s.user_id, strftime(s.ts, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(f.ts, '%Y-%m-%d %H:%M:%S') AS finished_at FROM events s JOIN events f ON f.user_id = s.user_id AND f.ts >= s.ts AND f.ts <= s.ts + INTERVAL 12 HOUR WHERE s.event_type = 'signup' AND f.event_type = 'purchase'""")
def stream_stages(spark, sf):
    out, cp = folders(spark)
    e = source(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    f = source(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    pairs = I.stage_pairs(e.filter("event_type = 'signup'"), f.filter("event_type = 'purchase'"), key="user_id", ts="ts", within="12 hours", delay="1 hour", how="inner")
    I.finish(I.write_append(pairs, out, cp))
    return spark.read.parquet(out).select("user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("started_at", "finished_at")])


@query("stream_log_append", "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def stream_log_append(spark, sf):
    out, cp = folders(spark)
    e = source(spark, sf, "events").withColumn("date", F.date_format("ts", "yyyy-MM-dd"))
    I.finish(I.append_log(e, out, cp))
    return spark.read.parquet(out).groupBy(F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("stream_latest_stage", "SELECT user_id, arg_max(event_type, ts) AS event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts FROM events GROUP BY 1")
def stream_latest_stage(spark, sf):
    out, cp = folders(spark)
    e = source(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    with rocksdb(spark):
        I.finish(I.write_updates(I.latest_stage(e, key="user_id", ts="ts", stage="event_type"), out, cp))
    newest = latest_per_key(spark.read.parquet(out).drop("batch"), ["user_id"], ["ts"])
    return newest.select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("stream_stages_open", """SELECT s.user_id, strftime(s.ts, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(f.ts, '%Y-%m-%d %H:%M:%S') AS finished_at FROM events s LEFT JOIN events f ON f.user_id = s.user_id AND f.event_type = 'purchase' AND f.ts >= s.ts AND f.ts <= s.ts + INTERVAL 12 HOUR WHERE s.event_type = 'signup'""")
def stream_stages_open(spark, sf):
    """Unfinished stages too: they come out once the watermark has passed."""
    out, cp = folders(spark)
    e = source(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    one, two = f"{out}-started", f"{out}-finished"

    def build():
        s, f = I.with_control(e, one), I.with_control(e, two)
        return I.stage_pairs(s.filter("event_type = 'signup'"), f.filter("event_type = 'purchase'"), key="user_id", ts="ts", within="12 hours", delay="1 hour")

    ends = {one: {"user_id": -1, "event_type": "signup"}, two: {"user_id": -2, "event_type": "purchase"}}
    to_the_end(spark, build, {one: e.schema, two: e.schema}, out, cp, ends)
    return spark.read.parquet(out).select("user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("started_at", "finished_at")])


ARRIVAL = "least(3, CAST(floor([HOURS] * 4 / (max([HOURS]) OVER () + 1)) AS INT) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END)"


@query("stream_late_rows", f"""WITH a AS (SELECT event_id, ts, {_dialect(ARRIVAL, spark=False)} AS arrival FROM events), m AS (SELECT arrival, max(ts) AS newest FROM a GROUP BY 1)
    SELECT event_id, coalesce(ts < (SELECT max(newest) FROM m WHERE m.arrival < a.arrival) - INTERVAL 1 DAY, false) AS late FROM a""")
def stream_late_rows(spark, sf):
    """Events arrive in four parts, one in ten a part later than its time; each is kept, late ones beside the others."""
    out, cp = folders(spark)
    e = table(spark, sf, "events").withColumn("arrival", F.expr(_dialect(ARRIVAL, spark=True))).withColumn("ts", F.col("ts").cast("timestamp"))
    for part in range(4):
        e.filter(F.col("arrival") == part).drop("arrival").coalesce(1).write.mode("append").parquet(f"{out}-source")
    stream = spark.readStream.schema(e.drop("arrival").schema).option("maxFilesPerTrigger", 1).parquet(f"{out}-source")
    I.finish(I.late_and_kept(stream, out, cp, ts="ts", delay_seconds=86_400))
    return spark.read.parquet(f"{out}/rows").select("event_id", F.col("late").cast("boolean").alias("late"))

"""Streams against their batch twins, late data, restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vidspark.checks.streams import stream_detections
from vidspark.operators.tracks import track
from vidspark.streaming import incremental as I
from vidspark.streaming.snapshot import commits, merge_batch, read_snapshot, upsert_stream
from vidspark.streaming.tracker import track_stream

T0 = dt.datetime(2024, 1, 1)


def write(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_tracker_stream_equals_batch(spark, sf, tmp_path):
    dets = stream_detections(spark, sf)
    for _ in range(2):
        I.finish(I.write_append(track_stream(I.with_control(dets, str(tmp_path / "control")), delay="1 second"), str(tmp_path / "out"), str(tmp_path / "cp")))
        I.flush_row(spark, str(tmp_path / "control"), dets.schema, ts="ts", at=dt.datetime(2100, 1, 1))
    got = {(r.video_id, r.det_id): r.track_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    e = spark.read.parquet(f"{sf}/events.parquet")
    from vidspark.checks.views import EVENT_INDEX, _dialect

    slot, k = F.expr(EVENT_INDEX), F.col("event_id")
    x, y = (slot * 120 + k % 11).cast("double"), (slot * 30 + k % 7).cast("double")
    batch = e.select(F.col("user_id").alias("video_id"), F.expr(_dialect("[HOURS]", spark=True)).alias("frame_number"), k.alias("det_id"), x.alias("x1"), y.alias("y1"), (x + 100).alias("x2"), (y + 100).alias("y2"))
    want = {(r.video_id, r.det_id): r.track_id for r in track(batch).collect()}
    assert got == want


def test_tracker_stream_continues_over_batches_and_disorder(spark, tmp_path):
    schema = "ts timestamp, video_id long, frame_number long, det_id long, x1 double, y1 double, x2 double, y2 double"
    rows = [(T0 + dt.timedelta(seconds=f), 1, f, 2 * f + o, 200.0 * o + f, 0.0, 200.0 * o + f + 90, 90.0) for f in range(40) for o in range(2)]
    for part in (rows[20:40][::-1] + rows[:20], rows[50:], rows[40:50], [(T0 + dt.timedelta(days=1), 2, 0, 999, 0.0, 0.0, 1.0, 1.0)]):
        write(spark, str(tmp_path / "in"), part, schema)
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        I.finish(I.write_append(track_stream(src, delay="1 minute"), str(tmp_path / "out"), str(tmp_path / "cp")))
    got = {r.det_id: r.track_id for r in spark.read.parquet(str(tmp_path / "out")).filter("video_id = 1").collect()}
    want = {r.det_id: r.track_id for r in track(spark.createDataFrame(rows, schema)).collect()}
    assert got == want


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    schema = "ts timestamp, k string"
    late = 0
    for i, part in enumerate(([(T0 + dt.timedelta(hours=h), "a") for h in range(30)], [(T0 + dt.timedelta(hours=1), "a"), (T0 + dt.timedelta(hours=29), "a")])):
        write(spark, str(tmp_path / "in"), part, schema)
        s = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), "k").count()
        q = I.finish(I.write_append(s, str(tmp_path / "out"), str(tmp_path / "cp")))
        late += I.late_rows(q)
    assert late == 1


def test_snapshot_rewrites_touched_buckets_only(spark, tmp_path):
    """Buckets written per batch, repeated batches, old commits, and a fresh checkpoint over an old table."""
    schema, table, root = "k long, a string, b string, seq long", "k long, a string, b string", str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, schema)
    merge = lambda rows, n, source="s": merge_batch(frame(rows), root, source=source, batch_id=n, keys=["k"], schema=table, order="seq", buckets=16, keep=2)
    assert merge([(k, "x", None, 1) for k in range(200)], 0) == 16
    assert merge([(1, None, "z", 2), (1, "y", None, 3)], 1) == 1
    assert merge([(1, "no", "no", 9)], 1) == 0 and merge([(5, "no", "no", 9)], 0) == 0  # repeated batches
    rows = lambda c=None: {r.k: (r.a, r.b) for r in read_snapshot(spark, root, table, c).collect()}
    assert rows() == {k: ("y", "z") if k == 1 else ("x", None) for k in range(200)}
    files = len(list((tmp_path / "t" / "rows").glob("commit=*/bucket=*")))
    assert files == 17  # the old bucket of key 1 is still named by the commit before
    assert merge([(2, "w", None, 4), (900, "new", None, 5)], 0, source="other") <= 2
    assert merge([(3, "w", None, 4)], 2) == 1 and merge([], 3) == 0
    assert commits(spark, root) == [3, 4] and len(rows()) == 201 and rows()[2] == ("w", None) and rows(3)[3] == ("x", None)
    assert len(list((tmp_path / "t" / "rows").glob("commit=*/bucket=*"))) <= 18
    assert merge([(2, "no", None, 9)], 0, source="other") == 0


def test_upsert_stream_over_batches_and_a_fresh_checkpoint(spark, tmp_path):
    schema = "k long, a string, b string, seq long"
    parts = [[(1, "x", None, 1), (2, "y", "q", 2)], [(1, None, "z", 3), (3, "w", None, 4)], [(2, "yy", None, 5)]]
    for n, part in enumerate(parts):
        write(spark, str(tmp_path / f"in{n // 2}"), part, schema)
        src = spark.readStream.schema(schema).parquet(str(tmp_path / f"in{n // 2}"))
        I.finish(upsert_stream(src, str(tmp_path / "t"), str(tmp_path / f"cp{n // 2}"), keys=["k"], schema="k long, a string, b string", order="seq"))
    newest = read_snapshot(spark, str(tmp_path / "t"), "k long, a string, b string").collect()
    assert {(r.k, r.a, r.b) for r in newest} == {(1, "x", "z"), (2, "yy", "q"), (3, "w", None)}


def test_keys_at_rest_leave_the_state(spark, tmp_path):
    schema = "ts timestamp, k long, stage string"
    at = lambda h: T0 + dt.timedelta(hours=h)
    state = []
    for part in ([(at(0), k, "new") for k in range(20)] + [(at(1), 3, "done")], [(at(100), 50, "new")], [(at(101), 50, "done"), (at(100.5), 50, "late")]):
        write(spark, str(tmp_path / "in"), part, schema)
        src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = I.finish(I.write_updates(I.latest_stage(src, key="k", ts="ts", stage="stage", rest_hours=10), str(tmp_path / "out"), str(tmp_path / "cp")))
        state.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    newest = {r.k: r.stage for r in spark.read.parquet(str(tmp_path / "out")).groupBy("k").agg(F.max_by("stage", "ts").alias("stage")).collect()}
    assert newest == {**{k: "new" for k in range(20)}, 3: "done", 50: "done"}
    assert state[1] < state[0] / 3 and state[2] < state[0] / 3, state


def test_sessions_leave_the_state_once_out(spark, tmp_path):
    schema = "ts timestamp, k long"
    rows = [(T0 + dt.timedelta(hours=h), h % 5) for h in range(0, 200)]
    write(spark, str(tmp_path / "in"), rows, schema)
    build = lambda: I.presence_sessions(I.with_control(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "c")), keys=["k"], ts="ts", gap="2 hours", delay="1 hour")
    q = I.finish(I.write_append(build(), str(tmp_path / "out"), str(tmp_path / "cp")))
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] < 5
    I.flush_row(spark, str(tmp_path / "c"), spark.read.schema(schema).parquet(str(tmp_path / "in")).schema, ts="ts", at=T0 + dt.timedelta(days=300))
    I.finish(I.write_append(build(), str(tmp_path / "out"), str(tmp_path / "cp")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200


def test_unfinished_stages_appear_after_the_watermark(spark, tmp_path):
    schema = "ts timestamp, k long"
    write(spark, str(tmp_path / "s"), [(T0, 1), (T0, 2), (T0 + dt.timedelta(days=3), 3)], schema)
    write(spark, str(tmp_path / "f"), [(T0 + dt.timedelta(minutes=5), 1), (T0 + dt.timedelta(days=3), 9)], schema)
    s, f = (spark.readStream.schema(schema).parquet(str(tmp_path / d)) for d in "sf")
    I.finish(I.write_append(I.stage_pairs(s, f, key="k", ts="ts", within="1 hour", delay="1 minute"), str(tmp_path / "out"), str(tmp_path / "cp")))
    got = {r.k: r.finished_at for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1] == T0 + dt.timedelta(minutes=5) and got[2] is None and 3 not in got


def test_duplicates_within_the_delay(spark, tmp_path):
    schema = "ts timestamp, digest string"
    for part in ([(T0, "a"), (T0, "a"), (T0, "b")], [(T0 + dt.timedelta(minutes=1), "a")], [(T0 + dt.timedelta(minutes=2), "c")]):
        write(spark, str(tmp_path / "in"), part, schema)
        s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        I.finish(I.write_append(I.unique_content(s, digest="digest", ts="ts", delay="1 hour"), str(tmp_path / "out"), str(tmp_path / "cp")))
    assert sorted(r.digest for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_tracker_stream_empty_frames_and_end(spark, tmp_path):
    """Empty frames end tracks, by rows without a detection or by the step; a closed video starts anew."""
    schema = "video_id long, ts timestamp, frame_number long, det_id long, x1 double, y1 double, x2 double, y2 double"
    box = (0.0, 0.0, 100.0, 100.0)
    at = lambda f: T0 + dt.timedelta(seconds=f)
    frames = [0, 1, 2, 50, 51]
    rows = [(v, at(f), f, 10 * v + i, *box) for v in (1, 2) for i, f in enumerate(frames)]
    rows += [(2, at(f), f, None, None, None, None, None) for f in range(3, 50)] + [(v, at(60), None, None, None, None, None, None) for v in (1, 2)]
    for name, step, want in (("rows", None, {1: 1, 2: 2}), ("step", 1, {1: 2, 2: 2})):
        src = tmp_path / f"src-{name}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src))
        out = str(tmp_path / f"out-{name}")
        I.finish(I.write_append(track_stream(spark.readStream.schema(schema).parquet(str(src)), delay="1 second", frame_step=step), out, str(tmp_path / f"cp-{name}")))
        got = spark.read.parquet(out).collect()
        assert len(got) == 2 * len(frames)
        assert {v: len({r.track_id for r in got if r.video_id == v}) for v in (1, 2)} == want


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_as_a_stream_in_one_file_or_many(spark, tmp_path, files):
    """A table that is a folder of files is read like one that is a single file beside others."""
    import os
    from vidspark.checks.streams import source

    whole = spark.range(30).withColumn("v", F.col("id") * 2)
    whole.repartition(files).write.parquet(str(tmp_path / "made"))
    os.makedirs(tmp_path / "sf")
    made = sorted((tmp_path / "made").glob("*.parquet"))
    if files == 1:
        (tmp_path / "sf" / "rows.parquet").write_bytes(made[0].read_bytes())
    else:
        os.makedirs(tmp_path / "sf" / "rows.parquet")
        for k, f in enumerate(made):
            (tmp_path / "sf" / "rows.parquet" / f"part-{k}.parquet").write_bytes(f.read_bytes())
    I.finish(I.write_append(source(spark, str(tmp_path / "sf"), "rows"), str(tmp_path / "out"), str(tmp_path / "cp")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30

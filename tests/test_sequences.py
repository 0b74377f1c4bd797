"""Set-based rewrites of sequential rules against the loops they replace, on many random groups."""

import random

import pytest
from pyspark.sql import functions as F

from vidspark.operators import frames, tracks, workflow
from vidspark.operators.common import numbered, with_previous
from vidspark.params import Admission, Tracking


def test_admission_equals_the_loop(spark):
    rng, new, old, want = random.Random(1), [], [], {}
    limits = Admission(per_person=5, per_day=2)
    for p in range(300):
        files = [f"P{p:03d}_{rng.randint(1, 4)}_{i:02d}" for i in range(rng.randint(0, 14))]
        rows = [(f, f"P{p:03d}" if rng.random() > 0.05 else None, f.split("_")[1]) for f in files]
        have = [r for r in rows if rng.random() < 0.35]
        extra = [(f"old_{p}_{i}", f"P{p:03d}", str(rng.randint(1, 4))) for i in range(rng.choice([0, 0, 1, 6]))]
        counted = [r for r in have + extra if r[1]]
        old += have + extra
        new += rows
        for f, person, day in sorted((r for r in rows if r not in have), reverse=True):
            if person is None:
                want[f] = (True, None)
            elif sum(c[1] == person for c in counted) >= 5:
                want[f] = (False, "person_limit")
            elif sum(c[1:] == (person, day) for c in counted) >= 2:
                want[f] = (False, "daily_limit")
            else:
                want[f] = (True, None)
                counted.append((f, person, day))
    schema = "filename string, person string, day string"
    got = workflow.admit_capped(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema), limits=limits).collect()
    assert {r.filename: (r.admitted, r.reason) for r in got} == want


@pytest.mark.parametrize("already", [0, 3])
def test_stop_at_target_equals_the_loop(spark, already):
    rng, rows, want = random.Random(2), [], set()
    for g in range(150):
        p = rng.choice([0.0, 0.02, 0.1, 0.4])
        flags = [rng.random() < p for _ in range(rng.choice([3, 50, 80, 170, 230]))]
        rows += [(g, i, f) for i, f in enumerate(flags)]
        accepted, fetched, pos = already, 0, 0
        while accepted < 10 and fetched < 150:
            chunk = list(enumerate(flags))[pos : pos + (50 if fetched == 0 else 30)]
            if not chunk:
                break
            pos += len(chunk)
            fetched += len(chunk)
            hits = 0
            for i, f in chunk:
                if accepted >= 10:
                    break
                accepted += f
                hits += f
                want.add((g, i, accepted))
            if accepted >= 10 or hits == 0:
                break
    df = spark.createDataFrame(rows, "g long, i long, ok boolean")
    got = workflow.stop_at_target(df, group="g", seq="i", accepted="ok", target=10, already=already).collect()
    assert {(r.g, r.i, r.accepted_so_far) for r in got} == want


def test_queue_equals_the_loop(spark):
    rng, rows, want = random.Random(4), [], {}
    for p in range(400):
        state = None
        for i in range(rng.randint(0, 9)):
            a, pr, top = rng.choice(["add", "add", "update", "remove", "finish"]), rng.choice(["high", "medium", "low"]), rng.random() < 0.3
            rows.append((f"p{p}", p * 100 + i, a, pr, top, f"s{i}", float(i), i))
            rank = workflow.PRIORITIES.index
            if a == "add":
                if state is None:
                    state = {"priority": pr, "source": f"s{i}", "order": None}
                elif rank(pr) < rank(state["priority"]):
                    state["priority"] = pr
            elif a == "update" and state:
                state["priority"] = pr
                state["order"] = 0 if top else state["order"]
            elif a in ("remove", "finish"):
                state = None
        if state:
            want[f"p{p}"] = (state["priority"], state["source"], state["order"])
    df = spark.createDataFrame(rows, "person string, seq long, action string, priority string, move_to_top boolean, source string, score double, ts long")
    assert {r.person: (r.priority, r.source, r.order) for r in workflow.queue_state(df).collect()} == want


def loop_tracker(frames, params):
    """frames: list of lists of boxes, empty lists included; returns ids in order of detection."""
    tracks_, ids = [], []

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        if w <= 0 or h <= 0:
            return 0.0
        return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)

    for boxes in frames:
        active = [t for t in tracks_ if not t["closed"]]
        pairs = sorted(((iou(t["box"], b), i, j) for i, t in enumerate(active) for j, b in enumerate(boxes)), key=lambda x: -x[0])
        owner, used = {}, set()
        for s, i, j in pairs:
            if s >= params.iou and i not in used and j not in owner:
                used.add(i)
                owner[j] = active[i]
                active[i].update(box=boxes[j], missed=0)
        for i, t in enumerate(active):
            if i not in used:
                t["missed"] += 1
                t["closed"] = t["missed"] > params.max_missing
        for j, b in enumerate(boxes):
            if j not in owner:
                owner[j] = {"id": len(tracks_), "box": b, "missed": 0, "closed": False}
                tracks_.append(owner[j])
            ids.append(owner[j]["id"])
    return ids


def video(rng, n):
    out, objects = [], [(0, 0), (60, 10), (300, 0)]
    for _ in range(n):
        objects = [(x + rng.randint(-15, 15), y + rng.randint(-5, 5)) for x, y in objects]
        seen = [o for o in objects if rng.random() < 0.7] if rng.random() < 0.75 else []
        out.append([(x, y, x + 80, y + 80) for x, y in seen])
    return out


@pytest.mark.parametrize("split", [True, False])
def test_tracker_equals_the_loop(spark, split):
    rng, rows, want = random.Random(6), [], {}
    for v in range(40):
        frames = video(rng, rng.randint(1, 60))
        ids, det = loop_tracker(frames, Tracking()), 0
        for f, boxes in enumerate(frames):
            for b in boxes:
                rows.append((v, f * 3, det, *map(float, b)))
                want[(v, det)] = ids[det]
                det += 1
            if not boxes and not split:
                rows.append((v, f * 3, None, None, None, None, None))
    df = spark.createDataFrame(rows, "video_id long, frame_number long, det_id long, x1 double, y1 double, x2 double, y2 double")
    got = tracks.track(df, frame_step=3 if split else None).collect()
    assert {(r.video_id, r.det_id): r.track_id for r in got} == want


def test_tracker_across_small_batches(spark):
    rng, rows = random.Random(8), []
    for f, boxes in enumerate(video(rng, 200)):
        rows += [(1, f, len(rows) + i, *map(float, b)) for i, b in enumerate(boxes)]
    df = spark.createDataFrame(rows, "video_id long, frame_number long, det_id long, x1 double, y1 double, x2 double, y2 double")
    want = {r.det_id: r.track_id for r in tracks.track(df).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.det_id: r.track_id for r in tracks.track(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_numbering_and_previous(spark):
    df = spark.range(2000).select((F.col("id") % 2 * F.when(F.col("id") % 3 == 0, 0).otherwise(1)).alias("k"), F.xxhash64("id").alias("v"))
    rows = numbered(df, ["k"], ["v"]).collect()
    for k in (0, 1):
        mine = sorted((r.v, r.rn) for r in rows if r.k == k)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))
    whole = sorted((r.v, r.rn) for r in numbered(df, [], ["v"]).collect())
    assert [n for _, n in whole] == list(range(1, 2001))
    for r in with_previous(df, ["k"], ["v"], ["v"]).collect():
        assert r.prev_v is None or r.prev_v < r.v


def test_rolling_means_across_blocks(spark):
    """One video holds most rows; nulls are left out; every block size gives the plain loop's means."""
    rng = random.Random(3)
    data = [(0 if rng.random() < 0.8 else rng.randint(1, 4), i, None if rng.random() < 0.2 else rng.uniform(0, 100)) for i in range(700)]
    df = spark.createDataFrame(data, "video_id long, f long, v double")
    want = {}
    for vid in range(5):
        mine = [(f, v) for d, f, v in data if d == vid]
        for k, (f, _) in enumerate(mine):
            seen = [v for _, v in mine[max(0, k - 6) : k + 1] if v is not None]
            want[vid, f] = round(sum(seen) / len(seen), 9) if seen else None
    for block in (1, 7, 8, 50, 100_000):
        got = frames.rolling_means(df, video="video_id", order=["f"], values=["v"], last=7, block=block).collect()
        assert len(got) == len(data)
        assert {(r.video_id, r.f): None if r.rolling_v is None else round(r.rolling_v, 9) for r in got} == want
    one = frames.rolling_means(df, video="video_id", order=["f"], values=["v"], last=1).collect()
    assert all(r.rolling_v == r.v for r in one)
    assert frames.rolling_means(df.limit(0), video="video_id", order=["f"], values=["v"], last=3).collect() == []


def test_people_of_an_analysis_and_the_fallback(spark):
    """Tracks win where they confirm anybody; lists may be null or missing; people without a name meet nobody."""
    tracked = spark.createDataFrame([(1, "Ana_Kos", 40, 88.5, 2)], "v long, person string, total_frames long, avg_confidence double, total_tracks int")
    voted = spark.createDataFrame([(1, "Ivo", 9, 70.0), (2, "Ivo", 12, 81.0), (3, "Eva", 5, 60.0)], "v long, person string, frame_count long, avg_confidence double")
    analyses = spark.createDataFrame(
        [(1, [("a", " ana kos ", "host")], None), (2, [("b", None, "guest"), ("c", "", None), None], [("d", "IVO"), ("e", "ivo")]), (4, [], [("f", "Eva")])],
        "v long, speakers array<struct<person_id:string,identified_name:string,role:string>>, people array<struct<person_id:string,identified_name:string>>",
    )
    confirmed = frames.confirmed_or_voted(tracked, voted, video="v")
    assert sorted(tuple(r) for r in confirmed.collect()) == [(1, "Ana_Kos", 40, 88.5, 2, "tracks"), (2, "Ivo", 12, 81.0, 1, "votes"), (3, "Eva", 5, 60.0, 1, "votes")]
    people = frames.analysed_people(analyses, video="v", fields=["speakers", "key_people", "people"])
    rows = frames.correlate_people(confirmed, people, video="v").collect()
    got = {(r.v, r.person_id, r.person, r.role, r.found_in) for r in rows}
    assert len(rows) == 7 and got == {
        (1, "a", "Ana_Kos", "host", "both"), (2, "b", None, "guest", "analysis"), (2, "c", None, None, "analysis"), (2, "d", "Ivo", None, "both"), (2, "e", "Ivo", None, "both"), (3, None, "Eva", None, "vectors"), (4, "f", None, None, "analysis"),
    }
    summary = {r.v: tuple(r)[1:] for r in frames.correlation_summary(confirmed, people, analyses, video="v").collect()}
    assert summary == {1: (True, 1, 1, 1, 1), 2: (True, 4, 2, 1, 1), 3: (False, 0, 0, 1, 0), 4: (True, 1, 1, 0, 0)}
    with pytest.raises(ValueError):
        frames.analysed_people(analyses, video="v", fields=["participants"])

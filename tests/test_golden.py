"""Worked examples of the survey."""

import pytest
from pyspark.sql import functions as F

from vidspark.functions import names as N
from vidspark.functions import scalars as S
from vidspark.functions import vectors as V
from vidspark.operators import catalog, gates, matching, tracks, workflow
from vidspark.operators.frames import dynamic_minimum, temporal_clusters, vote_frames
from vidspark.params import FrameVote, Tracking, TrackVote


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def boxes(*rows):
    return [F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), r)]) for r in rows]


@pytest.mark.parametrize("a, b, want", [((0, 0, 100, 100), (0, 0, 100, 100), 1.0), ((0, 0, 10, 10), (20, 20, 30, 30), 0.0), ((0, 0, 100, 100), (50, 0, 150, 100), 1 / 3), ((0, 0, 10, 10), (10, 0, 20, 10), 0.0)])
def test_iou(spark, a, b, want):
    assert one(spark, V.iou(*boxes(a, b)))[0] == pytest.approx(want)


def test_zero_vector(spark):
    z, v = F.array(*[F.lit(0.0)] * 3), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    r = one(spark, V.cosine_distance(z, v), V.cosine_distance(v, v), V.cosine_distance_eps(z, v))
    assert r[0] == 1.0 and r[1] == pytest.approx(0.0, abs=1e-12) and r[2] == pytest.approx(1.0)


def test_box_layouts(spark):
    texts = ['{"facial_area":{"x":10,"y":20,"w":100,"h":100}}', '{"facial_area":[10,20,100,100]}', '{"bbox":[1,2,3,4]}', '{"x1":1,"y1":2,"x2":3,"y2":4}', '{"region":{"x":1,"y":2,"w":3,"h":4}}', "{}", '{"bbox":[1,2]}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(V.normalise_box(F.col("t")).alias("b")).select("b.*").collect()
    assert [tuple(r) for r in rows] == [(10, 20, 110, 120), (10, 20, 110, 120), (1, 2, 3, 4), (1, 2, 3, 4), (1, 2, 4, 6), (0, 0, 100, 100), (0, 0, 100, 100)]


def dets(spark, rows):
    return spark.createDataFrame([(1, f, i, *map(float, b)) for i, (f, b) in enumerate(rows)], "video_id long, frame_number long, det_id long, x1 double, y1 double, x2 double, y2 double")


def test_tracker_create_and_extend(spark):
    far = tracks.track(dets(spark, [(0, (0, 0, 100, 100)), (1, (500, 500, 600, 600))])).collect()
    assert len({r.track_id for r in far}) == 2
    near = tracks.track(dets(spark, [(0, (0, 0, 100, 100)), (1, (10, 0, 110, 100))])).collect()
    assert [r.track_id for r in near] == [0, 0]


def test_short_track_is_not_valid(spark):
    t = tracks.track(dets(spark, [(0, (0, 0, 100, 100)), (1, (5, 0, 105, 100))]))
    s = tracks.track_statistics(tracks.track_lengths(t)).first()
    assert (s.total_tracks, s.valid_tracks, s.filtered_tracks, s.max_track_length, s.avg_track_length) == (1, 0, 1, 2, 0.0)


def test_track_closes_after_more_than_two_missed_frames(spark):
    a = (0, 0, 100, 100)
    rows = [(0, a), (1, (500, 0, 600, 100)), (2, (500, 0, 600, 100)), (3, a), (4, (500, 0, 600, 100)), (5, (500, 0, 600, 100)), (6, (500, 0, 600, 100)), (7, a)]
    ids = {r.det_id: r.track_id for r in tracks.track(dets(spark, rows)).collect()}
    assert ids[0] == ids[3] and ids[7] not in (ids[0], ids[1])


def test_track_vote(spark):
    rows = [(1, 1, i, i, p, c) for i, (p, c) in enumerate([("A", 80.0), ("A", 85.0), ("A", 90.0), ("B", 95.0), ("B", 92.0)])]
    v = spark.createDataFrame(rows, "video_id long, track_id long, det_id long, frame_number long, person string, confidence double")
    r = tracks.resolve_tracks(v, TrackVote()).first()
    assert (r.person, r.vote_count, r.vote_ratio, r.consistency, r.avg_confidence, r.best_confidence, r.track_length, r.resolved) == ("A", 3, 0.6, 0.6, 85.0, 90.0, 5, True)


def test_track_vote_tie_goes_to_the_first(spark):
    rows = [(1, 1, i, i, p, 90.0) for i, p in enumerate(["B", "A", "A", "B"])]
    v = spark.createDataFrame(rows, "video_id long, track_id long, det_id long, frame_number long, person string, confidence double")
    assert tracks.resolve_tracks(v).first().person == "B"


@pytest.mark.parametrize("frames, want", [([10, 11, 12, 50, 51, 52], True), ([10, 100, 200, 300, 400], False), ([10, 15, 20, 25, 30], True)])
def test_clustering(spark, frames, want):
    df = spark.createDataFrame([(1, f) for f in frames], "k long, frame_number long")
    assert temporal_clusters(df, keys=["k"]).first().is_clustered is want


def test_runs_do_not_depend_on_the_block_width(spark):
    from vidspark.operators.common import runs

    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.pmod(F.xxhash64("id"), F.lit(20000)).alias("f"))
    want = sorted(map(tuple, runs(df, ["k"], "f", max_gap=10).collect()))
    assert want == sorted(map(tuple, runs(df, ["k"], "f", max_gap=10, block=7).collect()))


def test_dynamic_minimum(spark):
    df = spark.createDataFrame([(n,) for n in (10, 40, 100, 200, 500, 600)], "n long")
    assert [r[0] for r in df.select(dynamic_minimum(F.col("n"))).collect()] == [5, 5, 5, 6, 15, 15]


def frames(spark, per_person):
    rows = [(1, i, True, p, float(c), 1) for p, cs in per_person.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "video_id long, frame_number long, recognized boolean, person string, confidence double, occurrences long")


def test_weighted_score(spark):
    got = {r.person: r.weighted_score for r in vote_frames(frames(spark, {"A": [70, 75, 72], "B": [45, 48, 42, 50, 46]})).collect()}
    assert got == {"A": 157.09, "B": 107.09}


def test_inconsistent_confidence_is_not_confirmed_unless_strict(spark):
    f = frames(spark, {"A": [10, 100, 10, 100, 10, 100]})
    assert vote_frames(f).first().confirmed is False
    assert vote_frames(f, params=FrameVote(strict_reference=True)).first().confirmed is True


def test_blocked_label_is_never_primary(spark):
    r = {x.person: x for x in vote_frames(frames(spark, {"Nikola Tesla": [95] * 9, "B": [90] * 6})).collect()}
    assert r["Nikola Tesla"].is_blocked and not r["Nikola Tesla"].confirmed and r["B"].is_primary


@pytest.mark.parametrize("path, want", [("x/Aca_Lukas_2025-05-29_15000311.png", "Aca_Lukas"), ("Abraham_Nnamdi_Nwankwo_2023-04-08_1745863063780.jpg", "Abraham_Nnamdi_Nwankwo"), ("A_B_2024_1745863063.jpg", "A_B"), ("A_B_2024_01_02_7.jpg", "A_B"), ("plain.jpg", "plain")])
def test_person_from_file(spark, path, want):
    assert one(spark, N.person_from_path(F.lit(path), "d"))[0] == want


def test_rules_a_to_c_differ(spark):
    p = F.lit("Ana-Marija_K_2024-01-05_7.jpg")
    assert tuple(one(spark, *[N.person_from_path(p, r) for r in "abc"])) == ("Ana-Marija_K", "", "")
    assert one(spark, N.person_from_path(F.lit("Ana_K_7.jpg"), "c"))[0] is None


def test_video_id(spark):
    assert one(spark, N.video_id(F.lit("20250520_143052_a1b2c3d4e5f6.mp4")))[0] == "a1b2c3d4e5f6"


def test_priority(spark):
    rows = []
    for p, (images, right, wrong) in {"a": (100, 29, 0), "b": (100, 49, 0), "c": (100, 79, 0), "d": (100, 80, 2), "e": (100, 90, 5)}.items():
        rows += [(p, p, True)] * right + [(p, "zzz", True)] * wrong + [(p, None, False)] * (images - right - wrong)
    df = spark.createDataFrame(rows, "person string, found string, recognized boolean")
    got = {r.person: r.priority for r in workflow.benchmark_scores(df, person="person", found="found").collect()}
    assert got == {"a": "high", "b": "medium", "c": "low", "d": "none", "e": "high"}


def test_unknown_model_costs_nothing(spark):
    df = spark.createDataFrame([("nobody", 10**6, 10**6), ("gpt-4o", 10**6, 10**6)], "model string, prompt_tokens long, completion_tokens long")
    assert {r.model: r.cost for r in catalog.token_cost(df).collect()} == {"nobody": 0.0, "gpt-4o": 12.5}


def test_face_class_and_sniff(spark):
    f = spark.createDataFrame([(1, 0.9, 1, 2, 40, 40), (2, 0.9, 1, 2, 60, 60), (2, 0.0, 1, 2, 60, 60), (3, 0.9, None, 2, 60, 60)], "im long, confidence double, left_eye int, right_eye int, w int, h int")
    assert {r.im: r.face_class for r in gates.face_count_class(f, image="im").collect()} == {1: -2, 2: 1, 3: 0}
    body = F.encode(F.repeat(F.lit("x"), 2000), "UTF-8")
    webp = F.concat(F.unhex(F.lit("524946460000000057454250")), body)
    assert one(spark, gates.looks_like_image(webp), gates.looks_like_image(body))[:] == (True, False)


def test_dates_and_places(spark):
    texts = ["2025-04-03", "03-04-2025 09:20:08", "03-04-2025", "3.4.2025 09:20:08", "03.04.2025", "soon"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.date_format(S.parse_date(F.col("t")), "yyyy-MM-dd HH:mm")).collect()]
    assert got == ["2025-04-03 00:00", "2025-04-03 09:20", "2025-04-03 00:00", "2025-04-03 09:20", "2025-04-03 00:00", None]
    assert one(spark, S.dms_to_decimal(F.array(F.lit(44.0), F.lit(30.0), F.lit(36.0)), F.lit("S")))[0] == pytest.approx(-44.51)
    assert one(spark, S.human_bytes(F.lit(1536)), S.human_bytes(F.lit(5)))[:] == ("1.50 KB", "5.00 B")


def test_relabelled_file_stays_unique(spark):
    stamp = F.lit("2024-01-01_9")
    same = N.relabelled_file(F.lit("ana_K_2024-01-05_7.JPG"), F.lit("Ana K"), stamp)
    other = N.relabelled_file(F.lit("x_2024-01-05_7.jpg"), F.lit("Đorđe Č"), stamp)
    assert one(spark, same, other)[:] == ("Ana_K_2024-01-05_7_2024-01-01_9.jpg", "Dorde_C_2024-01-05_7.jpg")


def test_group_boxes_matches_the_sequential_rule(spark):
    import random

    rng, rows, want = random.Random(5), [], set()
    for im in range(60):
        pts = [(rng.choice([0, 5, 9, 10, 11, 20, 21, 35]) * 1.0, rng.choice([0, 10, 12, 25]) * 1.0, rng.randint(1, 50) / 100) for _ in range(rng.randint(1, 12))]
        used = set()
        for i, (x, y, d) in enumerate(pts):
            rows.append((im, i, x, y, d))
            if i in used:
                continue
            group = [j for j in range(len(pts)) if j not in used and abs(pts[j][0] - x) <= 10 and abs(pts[j][1] - y) <= 10]
            used.update(group)
            want.add((im, min(group, key=lambda j: (pts[j][2], j))))
    df = spark.createDataFrame(rows, "image_id long, seq long, x_pct double, y_pct double, distance double")
    assert {(r.image_id, r.seq) for r in matching.group_boxes(df).collect()} == want


def test_vector_gate_splits_tracks(spark):
    rows = [(1, 0, 0, 0.0, 0.0, 9.0, 9.0, [1.0, 0.0]), (1, 1, 1, 0.0, 0.0, 9.0, 9.0, [0.0, 1.0]), (1, 2, 2, 0.0, 0.0, 9.0, 9.0, [0.0, 1.0])]
    d = spark.createDataFrame(rows, "video_id long, frame_number long, det_id long, x1 double, y1 double, x2 double, y2 double, embedding array<double>")
    assert [r.track_id for r in tracks.track(d, Tracking(vector_gate=0.6)).orderBy("det_id").collect()] == [0, 1, 1]

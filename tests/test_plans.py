"""Physical plans: no pair-wise joins, filters at the scan, limits before the shuffle; hot keys."""

import pytest
from pyspark.sql import functions as F

from vidspark.checks import load
from vidspark.operators import matching, naming, search, tracks, workflow
from vidspark.operators.common import runs, top_per_group

QUERIES, _ = load()
EAGER = {n for n in QUERIES if n.startswith("stream_")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_query_joins_all_pairs(name, spark, sf):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_gates_and_columns_reach_the_scan(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    text = plan(e.filter(F.col("user_id") == 3).groupBy("event_type").agg(F.count("*")))
    assert "EqualTo(user_id,3)" in text and "ReadSchema: struct<user_id:bigint,event_type:string>" in text


def test_rank_limits_run_before_the_shuffle(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    assert plan(top_per_group(e, ["user_id"], [F.col("value")], 3)).count("WindowGroupLimit") == 2
    files = e.select(F.col("event_id").cast("string").alias("filename"), F.col("event_type").alias("person"), F.col("user_id").cast("string").alias("day"))
    assert plan(workflow.admit_capped(files, files.filter("false"))).count("Partial") >= 2


def test_neighbour_blocks_stay_bounded_for_a_hot_group(spark):
    """A third and more of all rows in one group is cut into blocks on both sides."""
    rows = [(i, "hot" if i < 700 else f"g{i}", [float((i * 7) % 13), 1.0, float(i % 5)]) for i in range(1000)]
    v = spark.createDataFrame(rows, "vec_id long, grp string, embedding array<double>")
    out = search.neighbour_stats(v, group="grp", threshold=0.05, block_rows=64, broadcast_bytes=0)
    assert "FlatMapCoGroupsInPandas" in plan(out)
    hot = out.filter("grp = 'hot'").agg(F.sum("neighbours")).first()[0]
    whole = search.neighbour_stats(v, group="grp", threshold=0.05).filter("grp = 'hot'").agg(F.sum("neighbours")).first()[0]
    assert hot == whole


def test_hot_video_in_runs_and_votes(spark):
    f = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("frame_number"))
    hot = {r.k: r for r in runs(f, ["k"], "frame_number", max_gap=3, block=500).filter("k = 0").collect()}
    assert len(hot) == 1 and hot[0].n == 6667


def test_tracker_cuts_a_long_video_where_nothing_survives(spark):
    rows = [(1, f, i, 0.0, 0.0, 10.0, 10.0) for i, f in enumerate([*range(0, 50), *range(60, 90), *range(100, 130)])]
    d = spark.createDataFrame(rows, "video_id long, frame_number long, det_id long, x1 double, y1 double, x2 double, y2 double")
    ids = tracks.track(d, frame_step=1).groupBy("track_id").count().collect()
    assert sorted(r["count"] for r in ids) == [30, 30, 50]


def test_fuzzy_join_is_an_equi_join(spark):
    n = spark.createDataFrame([(i, f"name {i}") for i in range(50)], "person_id long, name string")
    text = plan(naming.similar_names(n))
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert text.count("ArrowEvalPython") == 1  # after the pairs are made distinct, and only there


def test_valid_box_join_uses_the_grid(spark):
    m = spark.range(100).select(F.lit(1).alias("im"), *[(F.col("id") % 17).cast("double").alias(c) for c in "xywh"])
    out = matching.keep_in_valid_boxes(m, m.limit(3), on="im", tol=1.0)
    assert "_cx" in plan(out) and out.count() == sum(1 for i in range(100) if i % 17 <= 3)


def test_sparse_hot_key_sends_two_rows_per_block(spark):
    """Positions further apart than the gap: only the first and last run of a block reach the second level."""
    from pyspark.sql import functions as F

    from vidspark.operators.common import runs

    points = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), (F.col("id") * 10).alias("pos"))
    got = {(r["key"], r["run_start"], r["run_end"], r["n"]) for r in runs(points, ["key"], "pos", max_gap=31, block=1000).collect()}
    want = set()
    for key, rows in {k: sorted(r["pos"] for r in rs) for k, rs in _by_key(points.collect()).items()}.items():
        start = before = rows[0]
        n = 0
        for p in rows:
            if p - before > 31:
                want.add((key, start, before, n))
                start, n = p, 0
            before, n = p, n + 1
        want.add((key, start, before, n))
    assert got == want


def _by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r["key"], []).append(r)
    return out


def test_no_local_checkpoints_on_a_cluster():
    """Without a shared folder only a session on one machine may go on."""
    import pytest

    from vidspark.session import checkpoint_root

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(RuntimeError):
        checkpoint_root(Session())


def test_one_person_with_many_vectors_hides_nobody(spark):
    """12 rows of the nearest person, then a second match and a near miss."""
    import math

    from vidspark.plans.recognition import recognise_images

    at = lambda d: [1 - d, math.sqrt(1 - (1 - d) ** 2)]
    rows = [(k, 1, "a", at(0.01 + k / 1000)) for k in range(12)] + [(20, 2, "a", at(0.3)), (21, 3, "a", at(0.5))]
    gallery = spark.createDataFrame(rows, "vec_id long, person_id long, domain string, embedding array<double>")
    persons = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "person_id long, name string")
    face = (1, 7, "a", at(0.0), 0.99, "l", "r", 1e4, 1e4, 128.0, 1e4, 50.0)
    faces = spark.createDataFrame([face], "probe_id long, image_id long, domain string, embedding array<double>, confidence double, left_eye string, right_eye string, blur double, contrast double, brightness double, edges double, area double")
    r = recognise_images(faces, gallery, persons, dim=2).first()
    assert (r["rejected"], r["persons_matched"], r["person"], r["near_person"]) == (0, 2, "one", "three")

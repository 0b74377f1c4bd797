"""Tracker, track votes, roll-ups and frame labels."""

from pyspark.sql import functions as F

from vidspark.checks.registry import query
from vidspark.checks.views import view
from vidspark.operators import tracks as T
from vidspark.params import TrackVote

RESOLVED = """per AS (SELECT video_id, track_id, person, count(*) AS votes, avg(confidence) AS a, max(confidence) AS b, min(frame_number * 1000000000 + det_id) AS f FROM track_votes WHERE person IS NOT NULL GROUP BY ALL),
    len AS (SELECT video_id, track_id, count(*) AS track_length, count(person) AS total_votes, min(frame_number) AS first_frame, max(frame_number) AS last_frame FROM track_votes GROUP BY ALL),
    lead_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY votes DESC, f) AS rn FROM per) x WHERE rn = 1),
    resolved AS (SELECT video_id, track_id, person, round(a, 2) AS avg_confidence, round(b, 2) AS best_confidence, coalesce(votes, 0) AS vote_count, total_votes, round(votes / total_votes, 3) AS vote_ratio,
        round(votes / track_length, 3) AS consistency, track_length, first_frame, last_frame, coalesce(votes / total_votes >= 0.5e0 AND round(votes / track_length, 3) >= 0.4e0 AND round(b, 2) >= 70, false) AS resolved
        FROM len LEFT JOIN lead_ USING (video_id, track_id))"""
VOTE = TrackVote(min_best=70.0)


@query("track")
def track(spark, sf):
    return T.track(view(spark, sf, "detections"), frame_step=1)


@query("track_per_slot", """WITH o AS (SELECT *, CASE WHEN frame_number - lag(frame_number) OVER (PARTITION BY video_id, slot ORDER BY frame_number) <= 3 THEN 0 ELSE 1 END AS o FROM single_detections),
    r AS (SELECT *, sum(o) OVER (PARTITION BY video_id, slot ORDER BY frame_number ROWS UNBOUNDED PRECEDING) AS run FROM o), t AS (SELECT video_id, slot, run, min(frame_number) AS f, arg_min(det_id, frame_number) AS d FROM r GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY f, d) - 1 AS track_id FROM t)
    SELECT video_id, frame_number, det_id, track_id FROM r JOIN n USING (video_id, slot, run)""", ("single_detections",))
def track_per_slot(spark, sf):
    """One detection per slot and frame, and slots that do not overlap: a track is then a run of frames
    with at most two missing, which SQL can say too."""
    return T.track(view(spark, sf, "single_detections"), frame_step=1)


@query("track_lengths")
def track_lengths(spark, sf):
    return T.track_lengths(T.track(view(spark, sf, "detections")))


@query("track_statistics", """WITH l AS (SELECT video_id, track_id, count(*) AS n FROM track_votes GROUP BY ALL) SELECT video_id, count(*) AS total_tracks, count(*) FILTER (n >= 3) AS valid_tracks, count(*) FILTER (n < 3) AS filtered_tracks,
    round(coalesce(avg(n) FILTER (n >= 3), 0), 4) AS avg_track_length, max(n) AS max_track_length FROM l GROUP BY 1""", ("track_votes",))
def track_statistics(spark, sf):
    s = T.track_statistics(T.track_lengths(view(spark, sf, "track_votes")))
    return s.withColumn("avg_track_length", F.round("avg_track_length", 4))


@query("track_vote_counts", "SELECT video_id, track_id, person, count(*) AS votes, round(avg(confidence), 4) AS avg_confidence, round(max(confidence), 4) AS best_confidence FROM track_votes GROUP BY ALL", ("track_votes",))
def track_vote_counts(spark, sf):
    c = T.vote_counts(view(spark, sf, "track_votes"))
    return c.select("video_id", "track_id", "person", "votes", F.round("avg_confidence", 4).alias("avg_confidence"), F.round("best_confidence", 4).alias("best_confidence"))


@query("resolve_tracks", f"WITH {RESOLVED} SELECT * FROM resolved", ("track_votes",))
def resolve_tracks(spark, sf):
    return T.resolve_tracks(view(spark, sf, "track_votes"), VOTE)


@query("person_rollup", f"""WITH {RESOLVED}, p AS (SELECT video_id, person, CAST(sum(track_length) AS BIGINT) AS total_frames, count(*) AS total_tracks, ((2 * CAST(sum(CAST(round(avg_confidence * 100) AS BIGINT)) AS BIGINT) + count(*)) // (2 * count(*))) / 100.0e0 AS avg_confidence, min(track_id) AS first_track, min(first_frame) AS first_frame, max(last_frame) AS last_frame FROM resolved WHERE resolved GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY total_frames DESC, first_track) = 1 AS is_primary FROM p""", ("track_votes",))
def person_rollup(spark, sf):
    return T.person_rollup(T.resolve_tracks(view(spark, sf, "track_votes"), VOTE))


@query("frame_labels", f"""WITH {RESOLVED}, fr AS (SELECT video_id, frame_number, count(*) AS faces FROM track_votes GROUP BY ALL UNION ALL SELECT video_id, -1, 0 FROM track_votes GROUP BY 1),
    c AS (SELECT DISTINCT v.video_id, v.frame_number, v.track_id, r.person, r.resolved, CASE WHEN r.resolved THEN r.avg_confidence ELSE 0.0 END AS confidence FROM track_votes v JOIN resolved r USING (video_id, track_id) WHERE r.track_length >= 3),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_number ORDER BY resolved DESC, confidence DESC, track_id) AS rn FROM c) x WHERE rn = 1)
    SELECT video_id, frame_number, faces, person, confidence, coalesce(resolved, false) AS recognized, track_id, coalesce(NOT resolved, false) AS unconfirmed FROM fr LEFT JOIN b USING (video_id, frame_number)""", ("track_votes",))
def frame_labels(spark, sf):
    v = view(spark, sf, "track_votes")
    frames = v.groupBy("video_id", "frame_number").agg(F.count("*").alias("faces"))
    blank = v.select("video_id").distinct().select("video_id", F.lit(-1).cast("long").alias("frame_number"), F.lit(0).cast("long").alias("faces"))
    return T.frame_labels(frames.unionByName(blank), v, T.resolve_tracks(v, VOTE))


@query("interval_join", """WITH t AS (SELECT video_id, track_id, min(frame_number) AS lo, max(frame_number) AS hi FROM track_votes GROUP BY ALL HAVING count(*) >= 4)
    SELECT d.video_id, t.track_id, count(*) AS n, min(d.det_id) AS first_det FROM track_votes d JOIN t ON d.video_id = t.video_id AND d.frame_number BETWEEN t.lo AND t.hi GROUP BY ALL""", ("track_votes",))
def interval_join(spark, sf):
    v = view(spark, sf, "track_votes")
    ranges = T.track_lengths(v).filter("track_length >= 4").select("video_id", "track_id", F.col("first_frame").alias("lo"), F.col("last_frame").alias("hi"))
    hits = T.interval_join(v.select("video_id", "det_id", "frame_number"), ranges, keys=["video_id"], pos="frame_number", lo="lo", hi="hi", width=24)
    return hits.groupBy("video_id", "track_id").agg(F.count("*").alias("n"), F.min("det_id").alias("first_det"))

"""From the detections of many videos to tracks, persons and frame labels."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidspark.functions.vectors import confidence_pct
from vidspark.operators.search import knn_join
from vidspark.operators.tracks import frame_labels, person_rollup, resolve_tracks, track, track_lengths
from vidspark.params import Tracking, TrackVote


class VideoResult(NamedTuple):
    tracked: DataFrame
    resolved: DataFrame
    persons: DataFrame
    labels: DataFrame


def analyse_videos(dets: DataFrame, gallery: DataFrame, persons: DataFrame, frames: DataFrame, *, tracking: Tracking = Tracking(), votes: TrackVote = TrackVote(), threshold: float = 0.40, frame_step: int | None = None, **knn) -> VideoResult:
    """Track, search each detection of a valid track, vote per track, roll up per person, label frames.
    Rows of detections with the same vector (`vec_id`) are searched once."""
    tracked = track(dets, tracking, frame_step=frame_step)
    long = track_lengths(tracked).filter(F.col("track_length") >= tracking.min_length)
    member = tracked.join(long.select("video_id", "track_id"), ["video_id", "track_id"], "left_semi").join(dets.select("video_id", "det_id", "vec_id"), ["video_id", "det_id"])
    distinct = dets.select(F.col("vec_id").alias("probe_id"), "domain", "embedding").dropDuplicates(["probe_id", "domain"])
    best = knn_join(distinct, gallery, k=1, threshold=threshold, cut="after", **knn).join(persons.select("person_id", F.col("name").alias("person")), "person_id")
    best = best.select(F.col("probe_id").alias("vec_id"), "person", confidence_pct(F.col("distance")).alias("confidence"))
    ballot = member.join(best, "vec_id", "left").select("video_id", "track_id", "det_id", "frame_number", "person", "confidence")
    resolved = resolve_tracks(ballot, votes)
    return VideoResult(tracked, resolved, person_rollup(resolved), frame_labels(frames, tracked, resolved, min_length=tracking.min_length))

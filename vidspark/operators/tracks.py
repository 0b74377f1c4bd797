"""Tracks over the detections of a video: greedy overlap tracking, votes, roll-ups, frame labels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vidspark.operators.common import runs, spread
from vidspark.params import Tracking, TrackVote

BOX = ["x1", "y1", "x2", "y2"]


class OpenTracks:
    """The open tracks of one video: the only state the tracker needs between frames."""

    def __init__(self, params: Tracking, next_id: int = 0):
        self.params, self.next_id = params, next_id
        self.ids: list[int] = []
        self.boxes = np.empty((0, 4))
        self.vectors: list[np.ndarray | None] = []
        self.missed: list[int] = []

    def skip(self, frames: int) -> None:
        """Processed frames without any detection."""
        if frames > 0:
            self.missed = [m + frames for m in self.missed]
            self._close()

    def step(self, boxes: np.ndarray, vectors: Sequence[np.ndarray | None] | None = None) -> list[int]:
        """Track id of each detection of the next frame; best overlap first, one to one."""
        vectors = list(vectors) if vectors is not None else [None] * len(boxes)
        overlap = _iou_matrix(self.boxes, boxes)
        if self.params.vector_gate is not None:
            for t, d in zip(*np.nonzero(overlap > 0)):
                if self.vectors[t] is not None and _cosine(self.vectors[t], vectors[d]) > self.params.vector_gate:
                    overlap[t, d] = 0.0
        t, d = np.nonzero(overlap >= self.params.iou)
        owner, extended = [-1] * len(boxes), set()
        for i in np.lexsort((d, t, -overlap[t, d])):
            if t[i] in extended or owner[d[i]] >= 0:
                continue
            extended.add(int(t[i]))
            owner[d[i]] = self.ids[t[i]]
            self.boxes[t[i]], self.vectors[t[i]] = boxes[d[i]], vectors[d[i]]
        self.missed = [0 if i in extended else m + 1 for i, m in enumerate(self.missed)]
        self._close()
        for i, o in enumerate(owner):
            if o < 0:
                owner[i] = self.next_id
                self.ids.append(self.next_id)
                self.boxes = np.vstack([self.boxes, boxes[i]])
                self.vectors.append(vectors[i])
                self.missed.append(0)
                self.next_id += 1
        return owner

    def _close(self) -> None:
        keep = [i for i, m in enumerate(self.missed) if m <= self.params.max_missing]
        if len(keep) < len(self.missed):
            self.ids, self.missed = [self.ids[i] for i in keep], [self.missed[i] for i in keep]
            self.vectors, self.boxes = [self.vectors[i] for i in keep], self.boxes[keep]


def _cosine(a: np.ndarray, b: np.ndarray | None) -> float:
    if b is None:
        return 0.0
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    scale = np.linalg.norm(a) * np.linalg.norm(b)
    return 1.0 if scale == 0 else 1.0 - float(a @ b) / scale


def _iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lo, hi = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    side = np.maximum(hi - lo, 0.0)
    inter = side[..., 0] * side[..., 1]
    area = lambda m: (m[:, 2] - m[:, 0]) * (m[:, 3] - m[:, 1])
    union = area(a)[:, None] + area(b)[None, :] - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=(union > 0) & (inter > 0))


def interval_join(points: DataFrame, ranges: DataFrame, *, keys: Sequence[str], pos: str, lo: str, hi: str, width: int = 1000) -> DataFrame:
    """Points inside ranges of the same key, as an equi join on (key, bucket of `width`)."""
    keys = list(keys)
    spread = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    placed = points.withColumn("_bucket", F.floor(F.col(pos) / width))
    return placed.join(spread, [*keys, "_bucket"]).filter(F.col(pos).between(F.col(lo), F.col(hi))).drop("_bucket")


def track(dets: DataFrame, params: Tracking = Tracking(), *, video: str = "video_id", frame: str = "frame_number", det: str = "det_id", frame_step: int | None = None) -> DataFrame:
    """Track id per detection.

    Frames of a video depend on each other, so a video is scanned in frame order with the open
    tracks as the only memory. Where the sampling step is known, the scan is cut wherever more than
    `max_missing` processed frames in a row are empty: no track survives that, so the pieces of a
    long video run in parallel. Without a step, the processed frames are those in the table; a
    processed frame without detections is a row whose `det` is null.
    """
    vec = ["embedding"] if params.vector_gate is not None else []
    rows = dets.select(video, frame, det, *BOX, *vec)
    if frame_step:
        pieces = runs(rows.filter(F.col(det).isNotNull()), [video], frame, max_gap=(params.max_missing + 1) * frame_step)
        pieces = pieces.select(video, F.col("run_start").alias("_piece"), "run_end")
        rows = interval_join(rows, pieces, keys=[video], pos=frame, lo="_piece", hi="run_end").drop("run_end")
    else:
        rows = rows.withColumn("_piece", F.lit(0).cast("long"))
    laid = spread(rows, video, "_piece").sortWithinPartitions(video, "_piece", frame, det)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tracker, current, last, held = None, None, None, None

        def run(b: pd.DataFrame, whole: bool) -> tuple[list[np.ndarray], np.ndarray, pd.DataFrame | None]:
            """Assign the complete frames of a batch; the last frame may continue in the next one."""
            nonlocal tracker, current, last
            vids, piece, nos = b[video].to_numpy(), b["_piece"].to_numpy(), b[frame].to_numpy()
            real, boxes = b[det].notna().to_numpy(), b[BOX].to_numpy(dtype=float)
            vectors = b["embedding"].to_numpy() if vec else None
            cut = np.flatnonzero((vids[1:] != vids[:-1]) | (piece[1:] != piece[:-1]) | (nos[1:] != nos[:-1])) + 1
            starts = np.concatenate([[0], cut, [len(b)]] if whole else [[0], cut]).astype(int)
            ids = np.full(len(b), -1, dtype=np.int64)
            for lo, hi in zip(starts[:-1], starts[1:]):
                if (vids[lo], piece[lo]) != current:
                    tracker, current, last = OpenTracks(params), (vids[lo], piece[lo]), None
                if frame_step and last is not None:
                    tracker.skip(int((nos[lo] - last) // frame_step) - 1)
                last = nos[lo]
                rows = np.flatnonzero(real[lo:hi]) + lo
                ids[rows] = tracker.step(boxes[rows], None if vectors is None else vectors[rows])
            end = starts[-1]
            return ids[:end], real[:end], None if whole else b.iloc[end:]

        def labelled(b: pd.DataFrame, ids: np.ndarray, real: np.ndarray) -> pd.DataFrame:
            return b.iloc[: len(ids)][[video, frame, det, "_piece"]].assign(_local=ids)[real]

        for b in batches:
            if len(b):
                b = b if held is None else pd.concat([held, b], ignore_index=True)
                ids, real, held = run(b, whole=False)
                yield labelled(b, ids, real)
        if held is not None and len(held):
            ids, real, _ = run(held.reset_index(drop=True), whole=True)
            yield labelled(held, ids, real)

    def typed(c: str) -> str:
        return f"`{c}` {dets.schema[c].dataType.simpleString()}"

    local = laid.mapInPandas(scan, f"{typed(video)}, {typed(frame)}, {typed(det)}, _piece long, _local long")
    if not frame_step:
        return local.select(video, frame, det, F.col("_local").alias("track_id"))
    sizes = local.groupBy(video, "_piece").agg((F.max("_local") + 1).alias("_n"))
    before = W.partitionBy(video).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(video, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return local.join(offsets, [video, "_piece"]).select(video, frame, det, (F.col("_local") + F.col("_off")).alias("track_id"))


def track_lengths(tracked: DataFrame, *, video: str = "video_id", track: str = "track_id", frame: str = "frame_number") -> DataFrame:
    return tracked.groupBy(video, track).agg(
        F.count(F.lit(1)).alias("track_length"), F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame")
    )


def track_statistics(lengths: DataFrame, *, video: str = "video_id", min_length: int = 3) -> DataFrame:
    n = F.col("track_length")
    return lengths.groupBy(video).agg(
        F.count(F.lit(1)).alias("total_tracks"), F.count_if(n >= min_length).alias("valid_tracks"), F.count_if(n < min_length).alias("filtered_tracks"),
        F.coalesce(F.avg(F.when(n >= min_length, n)), F.lit(0.0)).alias("avg_track_length"), F.max(n).alias("max_track_length"),
    )


def vote_counts(votes: DataFrame, *, video: str = "video_id", track: str = "track_id") -> DataFrame:
    """Votes per (video, track, person); person is null for detections without a match."""
    c = F.coalesce("confidence", F.lit(0.0))
    return votes.groupBy(video, track, "person").agg(
        F.count(F.lit(1)).alias("votes"), F.avg(c).alias("avg_confidence"), F.max(c).alias("best_confidence"),
        F.min(F.struct("frame_number", "det_id")).alias("first_vote"), F.min("frame_number").alias("_lo"), F.max("frame_number").alias("_hi"),
    )


def resolve_tracks(votes: DataFrame, params: TrackVote = TrackVote(), *, video: str = "video_id", track: str = "track_id") -> DataFrame:
    """Majority vote per track. Ties go to the person voted for first."""
    per = vote_counts(votes, video=video, track=track)
    voted = F.col("person").isNotNull()
    lead = F.struct((-F.col("votes")).alias("v"), "first_vote")
    g = per.groupBy(video, track).agg(
        F.sum("votes").alias("track_length"), F.coalesce(F.sum(F.when(voted, F.col("votes"))), F.lit(0)).alias("total_votes"),
        F.min("_lo").alias("first_frame"), F.max("_hi").alias("last_frame"),
        F.min_by(F.struct("person", "votes", "avg_confidence", "best_confidence"), F.when(voted, lead)).alias("_b"),
    )
    ratio, consistency = F.col("_b.votes") / F.col("total_votes"), F.round(F.col("_b.votes") / F.col("track_length"), 3)
    best = F.round(F.col("_b.best_confidence"), 2)
    ok = (ratio >= params.min_ratio) & (consistency >= params.min_consistency) & (best >= params.min_best)
    return g.select(
        video, track, F.col("_b.person").alias("person"), F.round("_b.avg_confidence", 2).alias("avg_confidence"), best.alias("best_confidence"),
        F.coalesce(F.col("_b.votes"), F.lit(0)).alias("vote_count"), "total_votes", F.round(ratio, 3).alias("vote_ratio"), consistency.alias("consistency"),
        "track_length", "first_frame", "last_frame", F.coalesce(ok, F.lit(False)).alias("resolved"),
    )


def person_rollup(resolved: DataFrame, *, video: str = "video_id", track: str = "track_id") -> DataFrame:
    """Persons of a video over their resolved tracks; the one with most frames is primary (ties: the
    earliest track). The tracks and ranges themselves are the rows of `resolved`."""
    per = resolved.filter("resolved").groupBy(video, "person").agg(
        F.sum("track_length").alias("total_frames"), F.count(F.lit(1)).alias("total_tracks"),
        F.round(F.avg(F.col("avg_confidence").cast("decimal(10,2)")), 2).cast("double").alias("avg_confidence"),
        F.min(track).alias("first_track"), F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"),
    )
    top = per.groupBy(video).agg(F.max_by("person", F.struct("total_frames", -F.col("first_track"))).alias("primary_person"))
    return per.join(top, video).withColumn("is_primary", F.col("person") == F.col("primary_person")).drop("primary_person")


def frame_labels(frames: DataFrame, tracked: DataFrame, resolved: DataFrame, *, video: str = "video_id", frame: str = "frame_number", track: str = "track_id", min_length: int = 3) -> DataFrame:
    """Best label per frame: a confirmed track beats an unconfirmed one, then the higher track
    confidence, then the lower track id. Frames without a track are kept."""
    valid = resolved.filter(F.col("track_length") >= min_length).select(video, track, "person", "resolved", F.when(F.col("resolved"), F.col("avg_confidence")).otherwise(0.0).alias("confidence"))
    cand = tracked.select(video, frame, track).join(valid, [video, track])
    best = cand.groupBy(video, frame).agg(
        F.max_by(F.struct("person", "confidence", "resolved", track), F.struct("resolved", "confidence", -F.col(track))).alias("_b")
    )
    return frames.join(best, [video, frame], "left").select(
        *frames.columns, F.col("_b.person").alias("person"), F.col("_b.confidence").alias("confidence"),
        F.coalesce("_b.resolved", F.lit(False)).alias("recognized"), F.col(f"_b.{track}").alias("track_id"),
        F.coalesce(~F.col("_b.resolved"), F.lit(False)).alias("unconfirmed"),
    )

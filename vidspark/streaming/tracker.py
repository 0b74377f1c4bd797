"""The overlap tracker over a stream of detections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vidspark.operators.tracks import BOX, OpenTracks
from vidspark.params import Tracking

PENDING = "ts_ms LONG, frame LONG, det LONG, real BOOLEAN, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
OPEN = "id LONG, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, missed LONG"
PLACE = "next_id LONG, last_frame LONG, last_ms LONG"
RESULT = ["video_id", "frame_number", "det_id", "track_id"]


class TrackState(StatefulProcessor):
    """Per video: detections that wait for the watermark, the open tracks, the next track id and the last
    frame. Frames may arrive in any order within the watermark delay; they are tracked in frame order once
    it has passed. A video that is closed and done, or has been idle for `idle_ms` of event time, leaves no
    state behind."""

    def __init__(self, params: Tracking, step: int | None, idle_ms: int):
        self.params, self.step, self.idle_ms = params, step, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", PENDING)
        self.open = handle.getListState("open", OPEN)
        self.place = handle.getValueState("place", PLACE)
        self.closed = handle.getValueState("closed", "closed BOOLEAN")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        oldest, newest, closed = None, None, False
        for b in rows:
            closed |= bool(b["frame_number"].isna().any())
            b = b[b["frame_number"].notna()]
            if not len(b):
                continue
            ms = b["ts"].astype("datetime64[us]").astype("int64") // 1000
            real, boxes = b["det_id"].notna(), b[BOX].astype(float)
            cols = [ms, b["frame_number"].astype("int64"), b["det_id"].where(real, 0).astype("int64"), real, *[boxes[c] for c in BOX]]
            self.pending.appendList([tuple(v) for v in zip(*[c.tolist() for c in cols])])
            oldest = int(ms.min()) if oldest is None else min(oldest, int(ms.min()))
            newest = int(ms.max()) if newest is None else max(newest, int(ms.max()))
        if closed:
            self.closed.update((True,))
        if oldest is not None:
            self.handle.registerTimer(oldest + 1)
            self.handle.registerTimer(newest + self.idle_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = list(self.pending.get()) if self.pending.exists() else []
        due = [r for r in waiting if r[0] <= mark]
        later = [r for r in waiting if r[0] > mark]
        if due:
            out = self._track(key, due)
            self.pending.clear()
            if later:
                self.pending.put([tuple(r) for r in later])
                self.handle.registerTimer(min(r[0] for r in later) + 1)
            yield out
        last = self.place.get()[2] if self.place.exists() else None
        if not later and last is not None and (self.closed.exists() or last + self.idle_ms <= mark):
            self._clear()

    def _track(self, key, due: list) -> pd.DataFrame:
        """Track ids of detections in frame order. With a step, frames that are missing between two
        processed ones were empty, as are frames of rows without a detection."""
        due = sorted(due, key=lambda r: (r[1], r[2]))
        next_id, last, last_ms = self.place.get() if self.place.exists() else (0, None, 0)
        tracker = OpenTracks(self.params, next_id=next_id)
        held = list(self.open.get()) if self.open.exists() else []
        if held:
            tracker.ids = [r[0] for r in held]
            tracker.boxes = np.array([r[1:5] for r in held], dtype=float)
            tracker.vectors = [None] * len(held)
            tracker.missed = [r[5] for r in held]
        out, i = [], 0
        while i < len(due):
            j = i
            while j < len(due) and due[j][1] == due[i][1]:
                j += 1
            if self.step and last is not None:
                tracker.skip((due[i][1] - last) // self.step - 1)
            last = due[i][1]
            real = [r for r in due[i:j] if r[3]]
            ids = tracker.step(np.array([r[4:8] for r in real], dtype=float).reshape(-1, 4))
            out += [(key[0], r[1], r[2], t) for r, t in zip(real, ids)]
            i = j
        self.open.clear()
        if tracker.ids:
            self.open.put([(int(t), *map(float, b), int(m)) for t, b, m in zip(tracker.ids, tracker.boxes, tracker.missed)])
        if due:
            self.place.update((int(tracker.next_id), int(last), int(max(last_ms or 0, *(r[0] for r in due)))))
        return pd.DataFrame(out, columns=RESULT)

    def _clear(self) -> None:
        self.pending.clear()
        self.open.clear()
        self.place.clear()
        self.closed.clear()

    def close(self) -> None:
        pass


def track_stream(dets: DataFrame, params: Tracking = Tracking(), *, delay: str = "10 minutes", frame_step: int | None = None, idle_minutes: int = 24 * 60) -> DataFrame:
    """Track ids of a detection stream (video_id, ts, frame_number, det_id, box). A row without a det_id is
    a processed frame that is empty; a row without a frame_number closes its video: stamped by more than
    the delay behind the last frame, it also moves the watermark on, so that nothing keeps waiting. A row without a video_id does only that, for all videos at once (`incremental.flush_row`).
    With `frame_step` the missing frames count as empty. Needs the RocksDB state store provider in the session."""
    cols = ["video_id", "ts", "frame_number", "det_id", *BOX]
    # a row without a video only moves the watermark on; the filter stays behind it, as it names the time
    marked = dets.select(*cols).withWatermark("ts", delay).filter(F.col("video_id").isNotNull() | F.col("ts").isNull())
    return marked.groupBy("video_id").transformWithStateInPandas(
        statefulProcessor=TrackState(params, frame_step, idle_minutes * 60_000), outputStructType="video_id LONG, frame_number LONG, det_id LONG, track_id LONG",
        outputMode="Append", timeMode="EventTime",
    )

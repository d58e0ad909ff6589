"""Candle identity across frames: a small state per session, folded over its frames.

The same fold serves a batch and a stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from statistics import median

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickline.config import timeframe_seconds

# One output row a frame; ids and candles are arrays in order.
FRAME_RESULT = (
    "session_id string, frame_id string, captured_at timestamp, status string, reason string, shift_px int, "
    "new_ids array<string>, updated_ids array<string>, closed_ids array<string>, "
    "candles array<struct<track_id:string,open_s:long,x:int,is_closed:boolean,first_seen:timestamp,last_seen:timestamp,confidence:double>>"
)


#: Timeframes back from the newest candle that a frame can show, at one pixel column each; older tracks are over.
KEPT = 16_384


class SessionTracks:
    """Tracks of one session: open second -> [first_seen, last_seen, is_closed, confidence], and the last frame's places."""

    def __init__(self, timeframe: str, shift_tolerance: int = 4, spacing_tolerance: float = 0.35) -> None:
        self.step, self.shift_tolerance, self.spacing_tolerance = timeframe_seconds(timeframe), shift_tolerance, spacing_tolerance
        self.tracks: dict[int, list] = {}
        self.places: dict[int, int] = {}
        self.spacing: float | None = None

    def dump(self) -> str:
        return json.dumps([sorted(self.tracks.items()), sorted(self.places.items()), self.spacing])

    def load(self, text: str) -> SessionTracks:
        tracks, places, self.spacing = json.loads(text)
        self.tracks, self.places = {int(k): v for k, v in tracks}, {int(k): v for k, v in places}
        return self

    def frame(self, session: str, at: pd.Timestamp, xs: list[int], confidences: list[float]) -> dict:
        """Outcome of one frame; a failed one leaves the tracks alone."""
        seen = sorted(zip(xs, confidences))
        places = [x for x, _ in seen]
        gaps = [b - a for a, b in zip(places, places[1:])]
        if not seen:
            return _lost("NO_CANDLES_TO_TRACK")
        if 0 in gaps:
            return _lost("DUPLICATE_CANDLE_X")
        spacing = float(median(gaps)) if gaps else None
        if spacing is not None:
            # the first frame's spacing is remembered even if the frame fails later
            if self.spacing is None:
                self.spacing = spacing
            elif any(abs(g - self.spacing) > self.spacing_tolerance * self.spacing for g in gaps):
                return _lost("INCONSISTENT_CANDLE_SPACING")
        second = int(at.timestamp() // 1)
        newest = second - second % self.step
        opens = [newest - self.step * back for back in range(len(seen) - 1, -1, -1)]
        shift = 0
        if self.places:
            moved = [x - self.places[o] for o, x in zip(opens, places) if o in self.places]
            if not moved:
                return _lost("NO_COMMON_CANDLE_IDENTITY")
            shift = round(float(median(moved)))
            if max(abs(m - shift) for m in moved) > self.shift_tolerance:
                return _lost("INCONSISTENT_HORIZONTAL_SHIFT")
        stamp = at.isoformat()
        out = {"status": "OK", "reason": None, "shift_px": shift, "new_ids": [], "updated_ids": [], "closed_ids": [], "candles": []}
        for o, (x, confidence) in zip(opens, seen):
            track_id, closed = f"{session}:{pd.Timestamp(o, unit='s', tz='UTC').isoformat()}", o < newest
            old = self.tracks.get(o)
            out["updated_ids" if old else "new_ids"].append(track_id)
            if old and closed and not old[2]:
                out["closed_ids"].append(track_id)
            self.tracks[o] = [old[0] if old else stamp, stamp, closed, min(old[3], confidence) if old else confidence]
            out["candles"].append({"track_id": track_id, "open_s": o, "x": x, "is_closed": closed, "first_seen": pd.Timestamp(self.tracks[o][0]), "last_seen": at, "confidence": self.tracks[o][3]})
        self.places, self.spacing = dict(zip(opens, places)), spacing if spacing is not None else self.spacing
        if len(self.tracks) > 2 * KEPT:
            self.tracks = {o: track for o, track in self.tracks.items() if o > newest - self.step * KEPT}
        return out


def _lost(reason: str) -> dict:
    return {"status": "TRACKING_LOST", "reason": reason, "shift_px": 0, "new_ids": [], "updated_ids": [], "closed_ids": [], "candles": []}


def frames_of(observations: DataFrame) -> DataFrame:
    """One row a frame, with its candles as arrays, from rows (session_id, frame_id, captured_at, x, confidence); x is null in empty frames."""
    pair = F.when(F.col("x").isNotNull(), F.struct("x", "confidence"))
    got = observations.groupBy("session_id", "frame_id", "captured_at").agg(F.array_sort(F.collect_list(pair)).alias("_seen"))
    return got.select("session_id", "frame_id", "captured_at", F.col("_seen.x").alias("xs"), F.col("_seen.confidence").alias("confidences"))


def fold_frames(state: SessionTracks, frames: pd.DataFrame) -> pd.DataFrame:
    """Outcomes of some of a session's frames, which are in order."""
    rows = []
    for session, frame, at, xs, confidences in frames[["session_id", "frame_id", "captured_at", "xs", "confidences"]].itertuples(index=False):
        at = at if at.tzinfo else at.tz_localize("UTC")
        rows.append({"session_id": session, "frame_id": frame, "captured_at": at} | state.frame(session, at, [int(x) for x in xs], [float(c) for c in confidences]))
    return pd.DataFrame(rows)


_STAMP, _NAMES = pa.timestamp("us", tz="UTC"), pa.list_(pa.string())
_CANDLES = pa.list_(pa.struct([("track_id", pa.string()), ("open_s", pa.int64()), ("x", pa.int32()), ("is_closed", pa.bool_()), ("first_seen", _STAMP), ("last_seen", _STAMP), ("confidence", pa.float64())]))
_RESULT = pa.schema([("session_id", pa.string()), ("frame_id", pa.string()), ("captured_at", _STAMP), ("status", pa.string()), ("reason", pa.string()), ("shift_px", pa.int32()), ("new_ids", _NAMES), ("updated_ids", _NAMES), ("closed_ids", _NAMES), ("candles", _CANDLES)])


def track(observations: DataFrame, timeframe: str, **tolerances) -> DataFrame:
    """FRAME_RESULT of every frame, each session's frames in order of captured_at and frame_id.

    The frames of a session come to one task in order and are folded as they
    stream by, so a task holds the state of one session.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, state = None, None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if state is None or row["session_id"] != session:
                    session, state = row["session_id"], SessionTracks(timeframe, **tolerances)
                at = pd.Timestamp(row["captured_at"])
                at = at if at.tzinfo else at.tz_localize("UTC")
                rows.append({"session_id": session, "frame_id": row["frame_id"], "captured_at": at} | state.frame(session, at, row["xs"], row["confidences"]))
            yield pa.RecordBatch.from_pylist(rows, _RESULT)

    frames = frames_of(observations).repartition("session_id").sortWithinPartitions("session_id", "captured_at", "frame_id")
    return frames.mapInArrow(run, FRAME_RESULT)


def tracks(results: DataFrame) -> DataFrame:
    """The tracks as they are after all frames."""
    rows = results.select("session_id", "captured_at", "frame_id", F.explode("candles").alias("c"))
    last = rows.groupBy("session_id", F.col("c.track_id").alias("track_id")).agg(F.max_by("c", F.struct("captured_at", "frame_id")).alias("c"))
    return last.select("session_id", "track_id", F.timestamp_seconds("c.open_s").alias("open_time"), "c.x", "c.is_closed", "c.first_seen", "c.last_seen", "c.confidence")

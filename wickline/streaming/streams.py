"""Structured Streaming: tracking, capture and the candle store as stateful operators.

Each has the same fold as its batch form.  State is kept by key and written to
the checkpoint that the sink names; that of candles that are over is evicted.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wickline.operators import capture, commits, pipeline, price_labels, store, tracking


def track(frames: DataFrame, timeframe: str, **tolerances) -> DataFrame:
    """FRAME_RESULT of a stream of frames (session_id, frame_id, captured_at, xs, confidences).

    The frames of a batch are taken in the order of captured_at and frame_id.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session = tracking.SessionTracks(timeframe, **tolerances)
        if state.exists:
            session.load(state.get[0])
        rows = pd.concat(list(batches)).sort_values(["captured_at", "frame_id"])
        out = tracking.fold_frames(session, rows)
        state.update((session.dump(),))
        yield out

    return frames.groupBy("session_id").applyInPandasWithState(step, tracking.FRAME_RESULT, "tracks string", "append", GroupStateTimeout.NoTimeout)


def observe(frames: DataFrame, folder: str, checkpoint: str, font: dict[str, str] = price_labels.FONT):
    """Read the pictures of a stream of frames (session_id, frame_id, captured_at, content) into ``folder``, a batch at a time.

    Each batch is one folder of ``pipeline.OBSERVED`` rows that appears whole or
    not at all; a batch replayed after a failure changes nothing.  :func:`observations`
    is the stream of what was read.
    """
    def step(batch: DataFrame, number: int) -> None:
        commits.published(pipeline.observed(batch, font), folder, f"batch={number:012d}")

    return frames.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def observations(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The stream of the frames that :func:`observe` has read into ``folder``; ``options`` are those of Spark's file source."""
    return spark.readStream.schema(f"{pipeline.OBSERVED}, batch long").options(**options).parquet(folder).drop("batch")


RECONSTRUCTED = (
    "session_id string, frame_id string, captured_at timestamp, status string, reason string, calibration_confidence double, shift_px int, "
    "new_ids array<string>, updated_ids array<string>, closed_ids array<string>, "
    "candles array<struct<open_s:long,last_seen:timestamp,open:double,high:double,low:double,close:double,is_closed:boolean,confidence:double>>"
)


def reconstruct(observed: DataFrame, timeframe: str, **tolerances) -> DataFrame:
    """RECONSTRUCTED of a stream of ``pipeline.OBSERVED`` rows: each frame's outcome, and its candles in prices.

    A session's state is its tracks and the last good calibration, which failed
    frames report (0.0 before the first).  The frames of a batch are taken in the
    order of captured_at and frame_id; one that comes in a later batch follows all
    of those before it.  ``pipeline.canonical`` gives the candles.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, good = tracking.SessionTracks(timeframe, **tolerances), 0.0
        if state.exists:
            text, good = state.get
            session.load(text)
        out = []
        for row in pd.concat(list(batches)).sort_values(["captured_at", "frame_id"]).to_dict("records"):
            at = pd.Timestamp(row["captured_at"])
            at = at if at.tzinfo else at.tz_localize("UTC")
            told = {"session_id": key[0], "frame_id": row["frame_id"], "captured_at": at, "status": row["status"], "reason": row["reason"], "calibration_confidence": good}
            told |= dict.fromkeys(("shift_px", "new_ids", "updated_ids", "closed_ids", "candles"))
            if row["status"] == "OK":
                bars = {int(b["x"]): b for b in row["bars"]}
                told |= session.frame(key[0], at, [int(b["x"]) for b in row["bars"]], [float(b["confidence"]) for b in row["bars"]])
                told["calibration_confidence"] = float(row["calibration_confidence"])
                told["candles"] = [{"open_s": c["open_s"], "last_seen": at, **{f: bars[c["x"]][f] for f in ("open", "high", "low", "close")}, "is_closed": c["is_closed"], "confidence": c["confidence"]} for c in told["candles"]]
                good = told["calibration_confidence"] if told["status"] == "OK" else good
            out.append(told)
        state.update((session.dump(), good))
        found = pd.DataFrame(out)
        yield found.assign(shift_px=found["shift_px"].astype("Int32"))

    return observed.groupBy("session_id").applyInPandasWithState(step, RECONSTRUCTED, "tracks string, good double", "append", GroupStateTimeout.NoTimeout)


CAPTURED = "session_id string, frame_id string, captured_at timestamp, image_hash string, changed boolean"


def changes(frames: DataFrame) -> DataFrame:
    """``changed`` of a stream of frames against the session's frame before."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["captured_at", "frame_id"])
        before = rows["image_hash"].shift(1)
        before.iloc[0] = state.get[0] if state.exists else rows["image_hash"].iloc[0]
        state.update((rows["image_hash"].iloc[-1],))
        yield rows[["session_id", "frame_id", "captured_at", "image_hash"]].assign(changed=(rows["image_hash"] != before).to_numpy())

    return frames.groupBy("session_id").applyInPandasWithState(step, CAPTURED, "last string", "append", GroupStateTimeout.NoTimeout)


def due(frames: DataFrame, interval_seconds: float = capture.INTERVAL_SECONDS) -> DataFrame:
    """``is_due`` of a stream of frames (session_id, frame_id, captured_at), as :func:`wickline.operators.capture.due` gives it.

    The frames of a batch are taken in the order of captured_at and frame_id.
    """
    micros = capture.interval_micros(interval_seconds)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["captured_at", "frame_id"])
        taken, last = [], state.get[0] if state.exists else None
        for at in rows["captured_at"].astype("datetime64[us]").astype("int64"):
            take = last is None or at - last >= micros
            last = at if take else last
            taken.append(take)
        state.update((int(last),))
        yield rows[["session_id", "frame_id", "captured_at"]].assign(is_due=taken)

    return frames.groupBy("session_id").applyInPandasWithState(step, "session_id string, frame_id string, captured_at timestamp, is_due boolean", "last long", "append", GroupStateTimeout.NoTimeout)


#: When a row came to the stream.
ARRIVED = "_arrived_at"


class _Fold(StatefulProcessor):
    """The evolution of one candle, kept in Spark's state: the canonical row, and what was saved at each time and by each observation."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "payload string, newest timestamp, closed boolean, timer long")
        self.at_time = handle.getMapState("at_time", "ts timestamp", "payload string")
        self.by_observation = handle.getMapState("by_observation", "observation_id string", "payload string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        fold, timer = store.CandleFold(), 0
        if self.current.exists():
            payload, newest, _, timer = self.current.get()
            fold.restore(payload, newest)
        fold.at_time, fold.by_observation = _Saved(self.at_time), _Saved(self.by_observation)
        told = [fold.save(row) for row in arrived.to_dict("records")]
        if fold.current is not None:
            until = round(time.time() * 1000) + self.keep_ms
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(until)
            self.current.update((fold.payload(), fold.newest, bool(fold.current["is_closed"]), until))
        yield arrived[["session_id", "open_time", "arrival", "observation_id"]].assign(outcome=told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.current.exists():
            payload, newest, closed, _ = self.current.get()
            if closed:
                for state in (self.current, self.at_time, self.by_observation):
                    state.clear()
            else:
                self.current.update((payload, newest, closed, 0))  # its next arrival sets a timer again
        yield pd.DataFrame(columns=["session_id", "open_time", "arrival", "observation_id", "outcome"])

    def close(self) -> None:
        pass


class _Saved:
    """A map of states as the fold asks for it: payloads by time or observation."""

    def __init__(self, state) -> None:
        self.state = state

    def get(self, key, default=None):
        return store.payload_of(self.state.getValue((key,))[0]) if self.state.containsKey((key,)) else default

    def __setitem__(self, key, payload: tuple) -> None:
        self.state.updateValue((key,), (store.payload_text(payload),))


def fold(arrivals: DataFrame, observations: DataFrame, keep_seconds: float = 86_400.0) -> DataFrame:
    """Outcome of every arrival of a stream, as :func:`wickline.operators.store.fold_arrivals` gives it.

    Arrivals of a batch are taken by ``arrival``.  The state of a candle that has
    closed goes when nothing has arrived for it for ``keep_seconds``; until then
    late snapshots are judged as in a batch, and those of open candles at any
    time.  Time passes as batches arrive: the watermark is that of arrival, so that
    no row is too late for it.  Needs the RocksDB state store (:data:`STATE_STORE`).
    """
    rows = store.observed(arrivals, observations).withColumn(ARRIVED, F.current_timestamp()).withWatermark(ARRIVED, "0 seconds")
    return rows.groupBy("session_id", "open_time").transformWithStateInPandas(_Fold(round(keep_seconds * 1000)), store.FOLDED, "append", "EventTime")


#: The setting that :func:`fold` needs of its session.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def candles(ticks: DataFrame, timeframe: str, late: str) -> DataFrame:
    """OHLC candles of a stream of ticks (session_id, ts timestamp, seq, price), emitted once the watermark has passed them."""
    from wickline.config import timeframe_seconds

    at = F.struct("ts", "seq")
    window = F.window("ts", f"{timeframe_seconds(timeframe)} seconds")
    grouped = ticks.withWatermark("ts", late).groupBy("session_id", window.alias("w"))
    return grouped.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("ticks")).select(
        "session_id", F.col("w.start").alias("open_time"), F.col("w.end").alias("close_time"), "open", "high", "low", "close", "ticks"
    )


def replay_stream(candles: DataFrame, clock) -> DataFrame:
    """The event-time gate on a stream of candles."""
    return candles.where(F.col("close_time") <= F.lit(clock))


def append_to_store(stream: DataFrame, held: store.Store, table: str, checkpoint: str):
    """Write a stream through the store's checks, a batch at a time; a batch replayed after a failure changes nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: held.append(table, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def save_to_store(arrivals: DataFrame, held: store.Store, checkpoint: str):
    """Fold a stream of arrivals into the store's candles, a batch at a time and each all or nothing; a batch replayed after a failure changes nothing."""
    return arrivals.writeStream.foreachBatch(lambda batch, _: held.save_candles(batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

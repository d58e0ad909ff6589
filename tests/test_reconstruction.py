from datetime import timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from wickline.config import timeframe_seconds
from wickline.operators import candles, capture, price_scale, reconstruction, replay, tracking
from wickline.sources import readers
from wickline.streaming import streams

from .conftest import BASE


def near(a, b):
    return abs(a - b) < 1e-9


TRUTH = [(100, 103, 98, 102), (102, 104, 99, 100)]
OHLC = "session_id string, asset string, timeframe string, open_time timestamp, open double, high double, low double, close double, arrival int"


def bars(spark, rows):
    return spark.createDataFrame([("s", "A", "1m", BASE + timedelta(minutes=m), *map(float, ohlc), i) for i, (m, ohlc) in enumerate(rows)], OHLC)


def test_metrics_of_shifted_prices(spark):
    got = reconstruction.metrics(bars(spark, [(i, [v + 0.5 for v in t]) for i, t in enumerate(TRUTH)]), bars(spark, list(enumerate(TRUTH)))).first()
    assert [got[f"{f}_mean_error"] for f in ("open", "high", "low", "close")] == [0.5] * 4
    assert (got.detection_rate, got.direction_accuracy, got.duplicate_rate, got.missing_rate) == (1, 1, 0, 0)


def test_metrics_of_duplicate_and_missing(spark):
    got = reconstruction.metrics(bars(spark, [(0, TRUTH[0]), (0, TRUTH[0])]), bars(spark, list(enumerate(TRUTH)))).first()
    assert (got.detection_rate, got.direction_accuracy, got.duplicate_rate, got.missing_rate) == (0.5, 1, 0.5, 0.5)


def test_metrics_without_rows_and_with_doubled_truth(spark):
    none = bars(spark, [(0, TRUTH[0])]).limit(0)
    got = reconstruction.metrics(none, none).first()
    assert got.open_mean_error is None and (got.detection_rate, got.duplicate_rate, got.truth_count) == (0, 0, 0)
    with pytest.raises(Exception, match="DUPLICATE_GROUND_TRUTH"):
        reconstruction.metrics(none, bars(spark, [(0, TRUTH[0]), (0, TRUTH[1])])).collect()


def anchors(spark, rows):
    return spark.createDataFrame([("s", *map(float, r)) if len(r) == 3 else ("s", *map(float, r), 0.95) for r in rows], "scale string, y double, price double, confidence double")


@pytest.mark.parametrize("rows, y, price", [([(100, 105), (200, 100)], 150, 102.5), ([(300, 95, .94), (100, 105, .97), (200, 100, .96)], 250, 97.5), ([(10, 10), (30, 20)], 20, 15), ([(100, 105), (200, 100)], 200, 100), ([(100, 105), (200, 100)], 99, None), ([(100, 105), (200, 100)], 201, None)])
def test_price_at(spark, rows, y, price):
    got = price_scale.prices_at(spark.createDataFrame([("s", float(y))], "scale string, y double"), anchors(spark, rows), ["scale"]).first()
    assert got.price == price and got.reason == (None if price is not None else "Y_OUTSIDE_CALIBRATED_RANGE")


@pytest.mark.parametrize("rows, reason", [([(100, 105)], "INSUFFICIENT_PRICE_ANCHORS"), ([(100, 105), (200, 95), (300, 100)], "NON_MONOTONIC_PRICE_ANCHORS"), ([(100, 105), (200, 100), (300, 80)], "INCONSISTENT_PRICE_ANCHORS"), ([(100, 105), (100, 104), (200, 100)], "DUPLICATE_PRICE_ANCHOR_Y"), ([(100, 105), (200, 100), (300, 95)], None)])
def test_calibration(spark, rows, reason):
    got = price_scale.calibrate(anchors(spark, rows), ["scale"]).first()
    assert got.reason == reason
    if reason is None:
        assert (got.orientation, got.min_y, got.max_y, got.confidence) == ("PRICE_INCREASES_UP", 100, 300, 0.95)


def test_candles_in_pixels(spark):
    visual = spark.createDataFrame([("s", 10, "UP", 120.0, 160.0, 110.0, None, 0.99), ("s", 20, "DOWN", 120.0, 160.0, None, 180.0, 0.5)], "scale string, x int, direction string, body_top double, body_bottom double, upper_top double, lower_bottom double, confidence double")
    a = anchors(spark, [(100, 200), (200, 100)])
    up, down = price_scale.map_candles(visual, a, ["scale"], price_scale.calibrate(a, ["scale"])).orderBy("x").collect()
    assert (up.open, up.high, up.low, up.close, up.confidence) == (140, 190, 140, 180, 0.95)
    assert (down.open, down.high, down.low, down.close, down.confidence) == (180, 180, 120, 140, 0.5)


FRAMES = [("12:00:20", [230, 365, 500]), ("12:00:45", [230, 365, 500]), ("12:01:05", [160, 295, 430, 565])]


def observations(spark, frames):
    rows = [("s", f"f{i}", BASE.replace(hour=int(t[:2]), minute=int(t[3:5]), second=int(t[6:])), x, 0.9 - 0.1 * i) for i, (t, xs) in enumerate(frames) for x in (xs or [None])]
    return spark.createDataFrame(rows, "session_id string, frame_id string, captured_at timestamp, x int, confidence double")


def test_tracker_follows_shift_and_closing(spark):
    one, two, three = tracking.track(observations(spark, FRAMES), "1m").orderBy("captured_at").collect()
    assert (len(one.new_ids), len(two.new_ids), len(two.updated_ids)) == (3, 0, 3)
    assert (three.shift_px, len(three.new_ids), len(three.closed_ids)) == (-70, 1, 1)
    final = tracking.tracks(tracking.track(observations(spark, FRAMES), "1m")).orderBy("open_time").collect()
    assert [r.is_closed for r in final] == [True, True, True, False] and near(final[0].confidence, 0.7)


@pytest.mark.parametrize("frames, reason", [([("12:00:20", [])], "NO_CANDLES_TO_TRACK"), ([("12:00:20", [1, 1])], "DUPLICATE_CANDLE_X"), ([FRAMES[0], ("12:00:45", [220, 360, 480, 700])], "INCONSISTENT_CANDLE_SPACING"), ([FRAMES[0], ("12:00:45", [220, 360, 510])], "INCONSISTENT_HORIZONTAL_SHIFT"), ([FRAMES[0], ("13:00:45", [230, 365, 500])], "NO_COMMON_CANDLE_IDENTITY")])
def test_tracker_failures(spark, frames, reason):
    got = tracking.track(observations(spark, frames), "1m").orderBy("captured_at").collect()[-1]
    assert (got.status, got.reason) == ("TRACKING_LOST", reason)


def test_stream_equals_batch(spark, tmp_path):
    frames = tracking.frames_of(observations(spark, FRAMES))
    for i, row in enumerate(frames.orderBy("captured_at").collect()):
        spark.createDataFrame([row], frames.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streams.track(stream, "1m").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    key = F.struct("captured_at", "status", "shift_px", "new_ids", "updated_ids", "closed_ids").cast("string")
    streamed = sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select(key).collect())
    assert streamed == sorted(r[0] for r in tracking.track(observations(spark, FRAMES), "1m").select(key).collect())


def test_capture_flags_and_cadence(spark):
    rows = [("s", f"f{i}", BASE + timedelta(seconds=t), h) for i, (t, h) in enumerate([(0, "a"), (2, "a"), (5, "b"), (9, "b"), (11, "a")])]
    df = spark.createDataFrame(rows, "session_id string, frame_id string, captured_at timestamp, image_hash string")
    assert [r.changed for r in capture.change_flags(df).orderBy("frame_id").collect()] == [False, False, True, False, True]
    assert [r.is_due for r in capture.due(df).orderBy("frame_id").collect()] == [True, False, True, False, True]
    import hashlib
    got = spark.createDataFrame([(2, 1, bytearray(b"abcdef"))], "w int, h int, p binary").select(capture.pixel_hash(F.col("w"), F.col("h"), F.col("p"))).first()[0]
    assert got == hashlib.sha256((2).to_bytes(4, "big") + (1).to_bytes(4, "big") + b"abcdef").hexdigest()


REPLAY = [("14:30", "100.00", "101.20", "99.80", "100.90"), ("14:31", "100.90", "101.50", "100.40", "101.10"), ("14:32", "101.10", "101.30", "100.20", "100.50")]


def replay_file(tmp_path, zone="+00:00", rows=REPLAY):
    import json
    candles = [{"timestamp": f"2026-01-05T{t}:00{zone}", "open": o, "high": h, "low": lo, "close": c} for t, o, h, lo, c in rows]
    path = tmp_path / "replay.json"
    path.write_text(json.dumps({"schema_version": 1, "asset": "X", "timeframe": "1m", "candles": candles}))
    return str(path)


def test_replay_clock(spark, tmp_path):
    r = replay.Replay(readers.replay_json(spark, replay_file(tmp_path)))
    r.start()
    assert r.advance(59).count() == 0 and r.advance(1).count() == 1
    r.pause()
    assert r.advance(120).count() == 0 and r.position == 1
    r.resume()
    assert [c["close"] for c in r.request_advance(60)["candles"]] == ["100.9", "101.1"]
    r.advance(60)
    assert r.status == replay.FINISHED
    r.start()
    assert r.status == replay.FINISHED
    r.reset()
    assert (r.status, r.clock, r.visible().count()) == (replay.IDLE, None, 0) and r.health() == {"status": "ok"}
    for bad in (0, 3601):
        with pytest.raises(ValueError):
            r.request_advance(bad)


def test_replay_files_are_checked(spark, tmp_path):
    with pytest.raises(Exception, match="timezone-aware"):
        readers.replay_json(spark, replay_file(tmp_path, zone="")).collect()
    with pytest.raises(Exception, match="HIGH_BELOW_BODY"):
        readers.replay_json(spark, replay_file(tmp_path, rows=[("14:30", "100", "99", "98", "100")])).collect()
    row = readers.replay_json(spark, replay_file(tmp_path)).orderBy("ordinal").first()
    assert row.open == Decimal("100.00") and row.close_time - row.open_time == timedelta(minutes=1)


def test_keep_latest_and_bands(spark):
    rows = [("s", BASE, BASE, 1, "a"), ("s", BASE, BASE, 2, "b"), ("s", BASE, BASE - timedelta(seconds=1), 3, "c")]
    df = spark.createDataFrame(rows, "session_id string, open_time timestamp, last_seen_at timestamp, arrival int, v string")
    assert candles.keep_latest(df).first()["v"] == "b"
    got = candles.bands(spark.createDataFrame([("k", v) for v in (1, 2, 3, 7, 9, 10)], "k string, v int"), ["k"], "v").orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(1, 3), (7, 7), (9, 10)]


def test_timeframes(spark):
    assert [timeframe_seconds(t) for t in ("30s", "1m", "4h", "1d")] == [30, 60, 14400, 86400]
    for bad in ("m", "0m", "1x", "1.5m", "-1m"):
        with pytest.raises(ValueError):
            timeframe_seconds(bad)
    got = spark.sql("SELECT timestamp'1969-12-31 23:59:59' t").select(candles.floor_time(F.col("t"), "1m").cast("string")).first()[0]
    assert got == "1969-12-31 23:59:00"

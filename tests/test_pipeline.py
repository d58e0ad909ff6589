from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wickline.operators import pipeline, price_labels, reconstruction, vision

from .conftest import BASE

AT = BASE.replace(hour=12, minute=0, second=0)
# (open, high, low, close) of three minutes, and of those still open
TRUTH = [(100, 103, 98.75, 101.75), (102, 103.75, 97.25, 99.25), (96.5, 101.75, 94, 99.5)]
FORMING, NEXT = (96.5, 98.0, 94, 97.0), (99.5, 100.5, 99.0, 100.0)
FRAMES = [("f1", 20, [230, 365, 500], [*TRUTH[:2], FORMING]), ("f2", 45, [230, 365, 500], TRUTH), ("f3", 65, [160, 295, 430, 565], [*TRUTH, NEXT])]


def drawn(xs, bars, labels=((105, 140), (100, 240), (95, 340), (90, 440))):
    """A chart at 0.05 a pixel: 112 - y / 20."""
    page = np.full((560, 800, 3), 255, dtype=np.uint8)
    page[60:480, 80:720] = vision.COLOURS["background"][0]
    page[60:480, 640] = page[470, 80:640] = vision.COLOURS["border"][0]
    for price, y in labels:
        price_labels.write_label(page, str(price), 660, y, (226, 232, 240), scale=2)
    for x, bar in zip(xs, bars):
        o, h, lo, c = (round((112 - p) * 20) for p in bar)
        colour = vision.COLOURS["UP" if bar[3] >= bar[0] else "DOWN"][0]
        page[h : lo + 1, x] = page[min(o, c) : max(o, c) + 1, x - 6 : x + 7] = colour
    return bytearray(vision.encode_png(page))


def run(spark, frames):
    images = spark.createDataFrame([(name, content) for name, _, content in frames], "image string, content binary")
    shown = spark.createDataFrame([(name, "s", AT + timedelta(seconds=s)) for name, s, _ in frames], "frame_id string, session_id string, captured_at timestamp")
    return pipeline.reconstruct(images, shown, "1m", "vision", "TEST")


def test_three_frames_give_the_truth(spark):
    got = run(spark, [(name, s, drawn(xs, bars)) for name, s, xs, bars in FRAMES])
    one, two, three = got.frames.orderBy("captured_at").collect()
    assert [r.status for r in (one, two, three)] == ["OK"] * 3 and one.calibration_confidence > 0.9
    assert (len(one.new_ids), len(two.new_ids), len(two.updated_ids)) == (3, 0, 3)
    assert (three.shift_px, len(three.new_ids), len(three.closed_ids)) == (-70, 1, 1)
    closed = got.candles.where("is_closed").orderBy("open_time").collect()
    assert [tuple(map(float, (r.open, r.high, r.low, r.close))) for r in closed] == [tuple(map(float, t)) for t in TRUTH]
    assert {(r.source_id, r.asset, r.timeframe) for r in closed} == {("vision", "TEST", "1m")} and all(0 < r.vision_confidence <= 1 for r in closed)
    truth = spark.createDataFrame([("s", "TEST", "1m", AT + timedelta(minutes=i - 2), *map(float, t)) for i, t in enumerate(TRUTH)], "session_id string, asset string, timeframe string, open_time timestamp, open double, high double, low double, close double")
    seen = got.candles.where("is_closed").withColumn("arrival", F.lit(1))
    metrics = reconstruction.metrics(seen, truth).first()
    assert [metrics[f"{f}_mean_error"] for f in ("open", "high", "low", "close")] == [0] * 4
    assert (metrics.detection_rate, metrics.direction_accuracy, metrics.duplicate_rate, metrics.missing_rate) == (1, 1, 0, 0)


def test_failed_frames_keep_their_reason_and_add_nothing(spark):
    xs, bars = FRAMES[0][2:]
    frames = [
        ("blank", 1, None), ("bare", 2, drawn([], [])), ("unlabelled", 3, drawn(xs, bars, labels=())), ("one", 4, drawn(xs, bars, labels=((105, 140),))),
        ("bent", 5, drawn(xs, bars, labels=((105, 140), (90, 240), (95, 340)))), ("beyond", 6, drawn(xs, bars, labels=((105, 140), (104, 160)))), ("fine", 20, drawn(xs, bars)),
    ]
    got = run(spark, frames)
    told = {r.frame_id: (r.status, r.reason) for r in got.frames.collect()}
    assert told == {
        "blank": ("LOW_IMAGE_QUALITY", "LOW_IMAGE_QUALITY"), "bare": ("CANDLE_DETECTION_FAILED", "CANDLE_DETECTION_FAILED"),
        "unlabelled": ("PRICE_SCALE_NOT_FOUND", "INSUFFICIENT_VISUAL_PRICE_ANCHORS"), "one": ("PRICE_SCALE_NOT_FOUND", "INSUFFICIENT_VISUAL_PRICE_ANCHORS"),
        "bent": ("PRICE_SCALE_NOT_FOUND", "NON_MONOTONIC_PRICE_ANCHORS"), "beyond": ("PRICE_SCALE_NOT_FOUND", "Y_OUTSIDE_CALIBRATED_RANGE"), "fine": ("OK", None),
    }
    assert got.candles.count() == 3


@pytest.mark.parametrize("scale", [1, 2, 3])
def test_every_number_is_read(spark, scale):
    page = np.zeros((40 * scale * 4, 70 * scale, 3), dtype=np.uint8)
    numbers = ["0123456789", "98765", "7", "40"]
    for i, text in enumerate(numbers):
        price_labels.write_label(page, text, 0, 30 * scale + 30 * scale * i, (255, 255, 255), scale)
    templates = {d: price_labels._inner(price_labels.glyph(x)) for d, x in price_labels.FONT.items()}
    assert [t for _, t, c in price_labels.read_labels(page, templates) if c > 0.9] == numbers
    assert price_labels.read_labels(np.zeros((50, 50, 3), np.uint8), templates) == []
    noise = np.random.default_rng(1).integers(0, 2, (9, 9)).astype(bool)
    blur = np.zeros((30, 30, 3), np.uint8)
    blur[5:14, 5:14][noise] = 255
    assert price_labels.read_labels(blur, templates, least=0.95) == []


def test_failed_frames_report_the_last_good_calibration(spark):
    xs, bars = FRAMES[0][2:]
    worse = drawn(xs, bars, labels=((105, 140), (100, 240), (95, 341), (90, 440)))  # a little uneven
    frames = [("a", 1, None), ("b", 20, drawn(xs, bars)), ("c", 25, None), ("d", 30, worse), ("e", 31, None), ("f", 32, drawn([300, 365, 500], bars)), ("g", 33, drawn(xs, bars, labels=()))]
    got = {r.frame_id: (r.status, r.calibration_confidence) for r in run(spark, frames).frames.collect()}
    assert [got[f][0] for f in "abcdefg"] == ["LOW_IMAGE_QUALITY", "OK", "LOW_IMAGE_QUALITY", "OK", "LOW_IMAGE_QUALITY", "TRACKING_LOST", "PRICE_SCALE_NOT_FOUND"]
    even, uneven = got["b"][1], got["d"][1]
    assert uneven < even and [got[f][1] for f in "aceg"] == [0.0, even, uneven, uneven]
    assert got["f"][1] == even  # its scale was read, though the tracker lost it


def test_a_chart_without_a_scale_says_so(spark):
    xs, bars = FRAMES[0][2:]
    page = vision.decode_png(bytes(drawn(xs, bars)))
    page[60:480, 640] = vision.COLOURS["background"][0]
    got = run(spark, [("f", 20, bytearray(vision.encode_png(page)))]).frames.first()
    assert (got.status, got.reason) == ("PRICE_SCALE_NOT_FOUND", "PRICE_SCALE_NOT_FOUND")


def test_pictures_are_read_once(spark):
    images = spark.createDataFrame([(name, drawn(xs, bars)) for name, _, xs, bars in FRAMES], "image string, content binary")
    state, seen = pipeline.priced_candles(images)
    for df in (state, seen):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and plan.count("Exchange hashpartitioning") < 15

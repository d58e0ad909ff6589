"""Streams against their batch forms, over shuffled batches and a restart from the checkpoint."""

import random
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from wickline import schema
from wickline.operators import capture, store
from wickline.streaming import streams

from .conftest import BASE
from .test_store import ARRIVAL, SESSION, at

OBSERVED = "observation_id string, session_id string, timestamp timestamp"


@pytest.fixture
def rocks(spark):
    for name, value in streams.STATE_STORE.items():
        spark.conf.set(name, value)
    yield spark
    for name in streams.STATE_STORE:
        spark.conf.unset(name)


def arrival(i, minute, second, high, low, close, closed, name, confidence=0.9):
    start = BASE + timedelta(minutes=minute)
    return ("s1", start, i, name, "vision", "TEST", "1m", start + timedelta(minutes=1), 100.0, float(high), float(low), float(close), closed, confidence, None)


def a_history(n=150):
    """Arrivals of a few candles with growth, late ones, repeats and contradictions, and their observations."""
    rng, rows, seen = random.Random(12), [], {}
    for i in range(n):
        minute, second = rng.randrange(5), max(0, min(89, i * 90 // n + rng.randrange(-14, 9)))
        name = f"o{minute}-{second}" if rng.random() < 0.9 else f"o{rng.randrange(5)}-{rng.randrange(90)}"
        seen.setdefault(name, (name, "s1" if rng.random() < 0.97 else "s2", at(second)))
        spread = 1 + second // 20 - (rng.random() < 0.1)
        rows.append(arrival(i, minute, second, 100 + spread, 100 - spread, 100 + rng.choice([0, 0.5, -0.5]), second > 60 and rng.random() < 0.1, name, rng.choice([0.9, None])))
        if rng.random() < 0.1:
            rows.append((*rows[-1][:2], i + n, *rows[-1][3:]))
    return sorted(rows, key=lambda r: r[2]), [o for o in seen.values() if o[0] != "o1-10"]


def run(spark, source, out, check, query):
    stream = spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", 1).parquet(source)
    query(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def put(spark, rows, source, at_time):
    """One file of rows; its time tells the stream the order."""
    before = {f for f in __import__("os").listdir(source)} if __import__("os").path.isdir(source) else set()
    spark.createDataFrame(rows, ARRIVAL).coalesce(1).write.mode("append").parquet(source)
    os = __import__("os")
    for f in set(os.listdir(source)) - before:
        os.utime(f"{source}/{f}", (at_time, at_time))


def test_the_fold_as_a_stream(rocks, tmp_path):
    rows, observations = a_history()
    seen = rocks.createDataFrame(observations, OBSERVED)
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    want = sorted(map(tuple, store.fold_arrivals(rocks.createDataFrame(rows, ARRIVAL), seen).select("arrival", "outcome").collect()))
    assert len({o for _, o in want}) > 8
    batches = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    for n, batch in enumerate(batches):
        random.Random(n).shuffle(batch)
        put(rocks, batch, source, 1_700_000_000 + n)
        if n == len(batches) - 2:
            run(rocks, source, out, check, lambda s: streams.fold(s, seen))  # then it stops, and goes on from its checkpoint
    run(rocks, source, out, check, lambda s: streams.fold(s, seen))
    assert sorted(map(tuple, rocks.read.parquet(out).select("arrival", "outcome").collect())) == want


def test_settled_candles_leave_the_state_and_open_ones_stay(rocks, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    seen = rocks.createDataFrame([(f"o{i}", "s1", at(20 + i)) for i in range(9)], OBSERVED)
    put(rocks, [arrival(0, 0, 20, 102, 98, 101, True, "o0"), arrival(1, 1, 20, 102, 98, 101, False, "o0")], source, 1_700_000_000)
    run(rocks, source, out, check, lambda s: streams.fold(s, seen, keep_seconds=0.5))
    held = lambda: {r.key.open_time for r in rocks.read.format("statestore").option("stateVarName", "current").load(check).collect()}
    assert len(held()) == 2
    time.sleep(1.5)
    put(rocks, [arrival(2, 2, 22, 102, 98, 101, False, "o2")], source, 1_700_000_001)  # a batch in which the timers fire
    run(rocks, source, out, check, lambda s: streams.fold(s, seen, keep_seconds=0.5))
    left = held()
    assert len(left) == 2 and BASE.replace(tzinfo=None) not in {t.replace(tzinfo=None) for t in left}
    put(rocks, [arrival(3, 1, 21, 101, 99, 100, False, "o1")], source, 1_700_000_002)  # the open candle goes on
    run(rocks, source, out, check, lambda s: streams.fold(s, seen, keep_seconds=0.5))
    assert {r.arrival: r.outcome for r in rocks.read.parquet(out).collect()} == {0: "INSERTED", 1: "INSERTED", 2: "INSERTED", 3: "CONFLICT:RANGE_SHRANK"}


def test_cadence_as_a_stream(spark, tmp_path):
    rng = random.Random(3)
    frames = [(f"s{rng.randrange(3)}", f"f{i:03d}", BASE + timedelta(seconds=rng.randrange(3) + 2 * i)) for i in range(90)]
    frames.sort(key=lambda f: f[2])
    kind = "session_id string, frame_id string, captured_at timestamp"
    want = sorted(map(tuple, capture.due(spark.createDataFrame(frames, kind)).collect()))
    import os
    for n in range(0, 90, 30):
        before = set(os.listdir(tmp_path / "in")) if n else set()
        spark.createDataFrame(frames[n : n + 30], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in set(os.listdir(tmp_path / "in")) - before:
            os.utime(tmp_path / "in" / f, (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.due(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("session_id", "frame_id", "captured_at", "is_due").collect())) == want


def test_a_stream_of_arrivals_is_saved_batch_by_batch(spark, tmp_path):
    held = store.Store(spark, str(tmp_path / "store"))
    held.append("sessions", spark.createDataFrame([SESSION], schema.SCHEMAS["sessions"]))
    held.append("frames", spark.createDataFrame([("f1", "s1", at(20), "hash", 8, 5, True, None)], schema.SCHEMAS["frames"]))
    held.append("observations", spark.createDataFrame([(f"o{i}", "s1", at(20 + i), "f1", 0.9, 0.95) for i in range(3)], schema.SCHEMAS["observations"]))
    source = str(tmp_path / "in")
    for n, (high, closed) in enumerate([(101, False), (103, False), (104, True)]):
        put(spark, [arrival(n, 0, 20 + n, high, 99, 100, closed, f"o{n}")], source, 1_700_000_000 + n)
    for check in ("check", "again"):  # the second reads everything again, and changes nothing
        stream = spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", 1).parquet(source)
        streams.save_to_store(stream, held, str(tmp_path / check)).awaitTermination()
        assert held.read("snapshots").count() == 3 and [(float(r.high), r.is_closed) for r in held.candles().collect()] == [(104, True)]


def test_capture_cuts_hashes_and_flags(spark):
    from wickline.operators import vision

    from .test_vision import picture

    one, two = picture(), picture([])
    two[0, 0] = 0  # outside the box
    rows = [("f1", "s", at(0), one, (80, 60, 100, 50)), ("f2", "s", at(5), two, (80, 60, 100, 50)), ("f3", "s", at(9), two, None), ("f4", "t", at(9), two, None)]
    frames = spark.createDataFrame([(f, s, t, bytearray(vision.encode_png(p)), *(b or [None] * 4)) for f, s, t, p, b in rows], "frame_id string, session_id string, captured_at timestamp, content binary, x int, y int, width int, height int")
    got = {r.frame_id: r for r in capture.captured(frames).collect()}
    assert [(got[f].width, got[f].height, got[f].changed_since_previous) for f in ("f1", "f2", "f3", "f4")] == [(100, 50, False), (100, 50, False), (800, 560, True), (800, 560, False)]
    assert (vision.decode_png(bytes(got["f1"].content)) == one[60:110, 80:180]).all() and got["f1"].image_hash == got["f2"].image_hash == vision.picture_hash(one[60:110, 80:180])
    with pytest.raises(Exception, match="within the picture"):
        capture.captured(frames.withColumn("x", F.lit(750)))
    with pytest.raises(Exception, match="could not be decoded"):
        capture.captured(frames.withColumn("content", F.lit(b"")))


def test_reconstruction_as_a_stream(spark, tmp_path):
    """Three batches of frames of two sessions, read and tracked with a stop between them, give what the batch form gives."""
    import os

    from wickline.operators import pipeline

    from .test_pipeline import AT, FRAMES, drawn

    xs, bars = FRAMES[0][2:]
    worse = drawn(xs, bars, labels=((105, 140), (100, 240), (95, 341), (90, 440)))
    shown = [("s", "a", 1, drawn([], [])), ("s", "b", 20, drawn(xs, bars)), ("t", "k", 21, worse), ("s", "c", 25, bytearray(b"?")), ("s", "d", 45, drawn(*FRAMES[1][2:])), ("t", "l", 46, drawn([300, 365, 500], bars)), ("t", "m", 50, drawn(xs, bars, labels=())), ("s", "e", 65, drawn(*FRAMES[2][2:]))]
    rows = [(s, f, AT + timedelta(seconds=at), content) for s, f, at, content in shown]
    kind = "session_id string, frame_id string, captured_at timestamp, content binary"
    source, seen, out = (str(tmp_path / x) for x in ("in", "seen", "out"))
    for n, batch in enumerate((rows[:3], rows[3:6], rows[6:])):
        before = set(os.listdir(source)) if n else set()
        spark.createDataFrame(batch[::-1], kind).coalesce(1).write.mode("append").parquet(source)
        for f in set(os.listdir(source)) - before:
            os.utime(f"{source}/{f}", (1_700_000_000 + n, 1_700_000_000 + n))
        frames = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
        streams.observe(frames, seen, str(tmp_path / "observe")).awaitTermination()
        result = streams.reconstruct(streams.observations(spark, seen), "1m")
        result.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    frames = spark.createDataFrame(rows, kind)
    want = pipeline.reconstruct(frames.select(F.col("frame_id").alias("image"), "content"), frames.select("session_id", "frame_id", "captured_at"), "1m", "vision", "TEST")
    got = spark.read.schema(streams.RECONSTRUCTED).parquet(out)
    told = ["session_id", "frame_id", "captured_at", "status", "reason", "calibration_confidence", "shift_px", "new_ids", "updated_ids", "closed_ids"]
    as_rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert as_rows(got.select(*told)) == as_rows(want.frames.select(*told)) and got.count() == len(rows)
    assert {r.status for r in got.collect()} > {"OK", "TRACKING_LOST", "PRICE_SCALE_NOT_FOUND"}
    assert as_rows(pipeline.canonical(got, "vision", "TEST", "1m")) == as_rows(want.candles) and want.candles.count() == 7
    # a batch that is replayed without its checkpoint changes nothing
    files = sorted(os.listdir(seen))
    frames = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
    streams.observe(frames, seen, str(tmp_path / "again")).awaitTermination()
    assert sorted(os.listdir(seen)) == files and spark.read.parquet(seen).count() == len(rows)

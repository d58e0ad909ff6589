"""The registered queries that SQL does not express, against plain loops over the whole table."""

import os
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone
from decimal import ROUND_HALF_EVEN, Context, Decimal
from statistics import median

import pytest

from wickline.operators import store
from wickline.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data is not here")


@pytest.fixture(scope="module")
def ticks(spark):
    return sorted((r.session_id, r.ts, r.seq, r.price) for r in queries.ticks(spark, SF).select("session_id", "ts", "seq", "price").collect())


def test_capture_cadence(spark, ticks):
    want, last = {}, {}
    for session, ts, seq, _ in sorted(ticks, key=lambda t: (t[0], t[1], str(t[2]))):
        want[session, str(seq)] = take = session not in last or ts - last[session] >= timedelta(hours=1)
        if take:
            last[session] = ts
    assert {(r.session_id, r.frame_id): r.is_due for r in queries.capture_cadence(spark, SF).collect()} == want


def test_tracked_frames(spark, ticks):
    """Each day's frame shows as many hours back from its newest as it has candles, ten pixels apart from 10 on."""
    hours = defaultdict(set)
    for session, ts, _, _ in ticks:
        hours[session, ts.date()].add(ts.replace(minute=0, second=0, microsecond=0))
    want, known, closed, places = [], defaultdict(set), defaultdict(set), {}
    for session, day in sorted(hours):
        n, newest = len(hours[session, day]), max(hours[session, day])
        opens = {newest - timedelta(hours=n - 1 - i): 10 * (i + 1) for i in range(n)}
        moved = [x - places[session][o] for o, x in opens.items() if o in places.get(session, {})]
        frame = (session, day.strftime("%Y%m%d"))
        if session in places and not moved:
            want.append((*frame, "TRACKING_LOST", "NO_COMMON_CANDLE_IDENTITY", 0, 0, 0, 0))
            continue
        shift = round(median(moved)) if moved else 0
        if moved and max(abs(m - shift) for m in moved) > 4:
            want.append((*frame, "TRACKING_LOST", "INCONSISTENT_HORIZONTAL_SHIFT", 0, 0, 0, 0))
            continue
        old = known[session] & set(opens)
        now_closed = {o for o in opens if o < newest}
        want.append((*frame, "OK", None, shift, len(opens) - len(old), len(old), len((now_closed & old) - closed[session])))
        known[session] |= set(opens)
        closed[session] = (closed[session] - set(opens)) | now_closed
        places[session] = opens
    assert sorted(map(str, map(tuple, queries.tracked_frames(spark, SF).collect()))) == sorted(map(str, want))


def test_conflict_fold(spark):
    rows = queries._altered(spark, SF).collect()
    ts = {r.seq: (r.session_id, r.ts) for r in queries.ticks(spark, SF).select("seq", "session_id", "ts").collect()}
    by_candle = defaultdict(list)
    for r in rows:
        by_candle[r.session_id, r.open_time].append((r.seq + (40 if r.seq % 10 == 3 else 0), r))
    want = Counter()
    for (session, opened), arrivals in by_candle.items():
        assert len({a for a, _ in arrivals}) == len(arrivals)
        fold = store.CandleFold()
        for _, r in sorted(arrivals, key=lambda x: x[0]):
            seen = ts[r.seq]
            row = {"session_id": session, "open_time": opened, "source_id": "events", "asset": session, "timeframe": "1h", "close_time": opened + timedelta(hours=1), "open": r.open, "high": r.high, "low": r.low, "close": r.close, "is_closed": r.is_closed, "vision_confidence": r.confidence, "source_confidence": None}
            want[session, fold.save(row | {"observation_id": r.seq, "observed": True, "observed_session": seen[0], "ts": seen[1]})] += 1
    assert {(r.session_id, r.outcome): r.arrivals for r in queries.conflict_fold(spark, SF).collect()} == dict(want)


def closes(spark):
    found = defaultdict(list)
    for r in queries.closing(spark, SF).select("session_id", "open_time", "close").collect():
        found[r.session_id].append((r.open_time, r.close))
    return {s: sorted(rows) for s, rows in found.items()}


EXACT = Context(prec=28, rounding=ROUND_HALF_EVEN)


def change(now, before):
    a, b = Decimal(str(now)), Decimal(str(before))
    return EXACT.divide(EXACT.subtract(a, b), b) if b else None


def test_exact_returns(spark):
    want = {}
    for session, rows in closes(spark).items():
        for i, (at, close) in enumerate(rows):
            want[session, at] = change(close, rows[i - 1][1]) if i else None
    got = {(r.session_id, r.open_time): r.return_text for r in queries.exact_returns(spark, SF).collect()}
    assert set(got) == set(want)
    assert all((got[k] is None) == (want[k] is None) and (got[k] is None or Decimal(got[k]) == want[k]) for k in want)


def test_exact_volatility(spark):
    want = {}
    for session, rows in closes(spark).items():
        for i, (at, _) in enumerate(rows):
            changes = [change(rows[j][1], rows[j - 1][1]) for j in range(i - 3, i + 1)] if i >= 4 else [None]
            if None in changes:
                want[session, at] = None
                continue
            mean = EXACT.divide(sum(changes), Decimal(4))
            want[session, at] = EXACT.sqrt(EXACT.divide(sum((c - mean) ** 2 for c in changes), Decimal(4)))
    got = {(r.session_id, r.open_time): r.volatility_exact for r in queries.exact_volatility(spark, SF).collect()}
    assert set(got) == set(want)
    assert all((got[k] is None) == (want[k] is None) and (got[k] is None or abs(Decimal(got[k]) - want[k]) <= Decimal("1e-15")) for k in want)


def test_streams(spark, tmp_path, ticks):
    """Change flags, candles, the replay's gate and the store's sink as streams give what the batch forms give."""
    from pyspark.sql import functions as F

    from wickline import schema
    from wickline.operators import candles, capture, replay
    from wickline.streaming import streams

    rows = [(s, f"{seq:012d}", t.replace(tzinfo=timezone.utc), str(int(p) // 10), seq, float(p)) for s, t, seq, p in ticks]
    df = spark.createDataFrame(rows, "session_id string, frame_id string, captured_at timestamp, image_hash string, seq long, price double")
    df.orderBy("captured_at").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(stream, name, mode="append"):
        stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    flags = run(streams.changes(source.select("session_id", "frame_id", "captured_at", "image_hash")), "flags")
    assert {(r.frame_id, r.changed) for r in flags.collect()} == {(r.frame_id, r.changed) for r in capture.change_flags(df).collect()}
    made = run(streams.candles(source.withColumnRenamed("captured_at", "ts"), "1h", "0 seconds"), "made")
    whole = {(r.session_id, r.open_time, r.open, r.high, r.low, r.close, r.ticks) for r in candles.candles(df.withColumnRenamed("captured_at", "ts").withColumn("open_time", candles.floor_time(F.col("ts"), "1h")).withColumn("confidence", F.lit(1.0))).collect()}
    got = {(r.session_id, r.open_time, r.open, r.high, r.low, r.close, r.ticks) for r in made.collect()}
    assert got <= whole and len(whole) - len(got) <= len({s for s, *_ in ticks})  # the newest are still open
    closing = source.select("frame_id", F.col("captured_at").alias("close_time"))
    clock = datetime(2024, 1, 15, tzinfo=timezone.utc)
    gate = run(streams.replay_stream(closing, clock), "gate")
    assert gate.count() == replay.visible(df.withColumnRenamed("captured_at", "close_time"), clock).count() > 0
    s = store.Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("s1", "x", "A", "1m", clock, None)], schema.SCHEMAS["sessions"])
    rows.write.parquet(str(tmp_path / "sessions"))
    sessions = spark.readStream.schema(schema.SCHEMAS["sessions"]).parquet(str(tmp_path / "sessions"))
    streams.append_to_store(sessions, s, "sessions", str(tmp_path / "check")).awaitTermination()
    assert s.read("sessions").count() == 1

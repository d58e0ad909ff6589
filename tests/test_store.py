from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from wickline import schema
from wickline.operators import store

from .conftest import BASE


def at(seconds):
    return BASE + timedelta(seconds=seconds)


SESSION = ("s1", "replay-source", "TEST", "1m", at(-300), None)


@pytest.fixture
def filled(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    s.append("sessions", spark.createDataFrame([SESSION], schema.SCHEMAS["sessions"]))
    s.append("frames", spark.createDataFrame([("f1", "s1", at(20), "hash-f1", 800, 560, True, None)], schema.SCHEMAS["frames"]))
    return s


def test_insert_is_idempotent_and_refuses_conflicts(spark, filled):
    assert filled.healthy()
    row = spark.createDataFrame([("o1", "s1", at(20), "f1", 0.9, 0.95)], schema.SCHEMAS["observations"])
    assert filled.append("observations", row) == 1
    assert filled.append("observations", row) == 0
    with pytest.raises(store.Conflict):
        filled.append("observations", row.withColumn("confidence", F.lit(0.8)))
    assert filled.get("observations", observation_id="o1")["confidence"] == 0.9
    assert filled.get("observations", observation_id="o2") is None


def test_parents_and_rules(spark, filled):
    with pytest.raises(ValueError, match="without sessions"):
        filled.append("observations", spark.createDataFrame([("o9", "nobody", at(1), "f1", 0.9, 0.9)], schema.SCHEMAS["observations"]))
    with pytest.raises(ValueError, match="confidence_range"):
        filled.append("observations", spark.createDataFrame([("o9", "s1", at(1), "f1", float("nan"), 0.9)], schema.SCHEMAS["observations"]))
    with pytest.raises(ValueError, match="ends_before_start"):
        filled.append("sessions", spark.createDataFrame([("s2", "x", "y", "1m", at(0), at(-1))], schema.SCHEMAS["sessions"]))
    naive = spark.createDataFrame([SESSION], schema.SCHEMAS["sessions"]).withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))
    with pytest.raises(ValueError, match="timezone-aware"):
        filled.append("sessions", naive)
    assert filled.read("analyses").count() == 0


ARRIVAL = "session_id string, open_time timestamp, arrival long, observation_id string, source_id string, asset string, timeframe string, close_time timestamp, open double, high double, low double, close double, is_closed boolean, vision_confidence double, source_confidence double"


def outcomes(spark, states, seen=None):
    """Outcomes of (seconds, high, low, close, closed[, observation]) in arrival order; each has its own observation unless named."""
    rows, observed = [], {}
    for i, (second, high, low, close, closed, *name) in enumerate(states):
        name = name[0] if name else f"o{i}"
        observed[name] = (name, "s1", at(second))
        rows.append(("s1", BASE, i, name, "vision", "TEST", "1m", BASE + timedelta(minutes=1), 100.0, float(high), float(low), float(close), closed, 0.9, None))
    observations = spark.createDataFrame(list(observed.values()) if seen is None else seen, "observation_id string, session_id string, timestamp timestamp")
    return [r.outcome for r in store.fold_arrivals(spark.createDataFrame(rows, ARRIVAL), observations).orderBy("arrival").collect()]


def test_lifecycle_of_a_candle(spark):
    life = [(20, 103, 99, 101, False), (45, 104, 98, 99, False), (65, 104, 98, 100, True)]
    assert outcomes(spark, life) == ["INSERTED", "EVOLVED", "EVOLVED"]
    assert outcomes(spark, life + [(65, 104, 98, 100, True)]) [3] == "UNCHANGED"
    assert outcomes(spark, life + [(65, 104, 98, 100, True, "o2")])[3] == "NOOP"


@pytest.mark.parametrize("states, expected", [
    ([(20, 103, 99, 101, False), (20, 103, 99, 102, False)], "CONFLICT:SAME_TIME"),
    ([(20, 103, 99, 101, True), (40, 103, 99, 102, True)], "CONFLICT:ALREADY_CLOSED"),
    ([(20, 104, 99, 101, False), (40, 103, 99, 101, False)], "CONFLICT:RANGE_SHRANK"),
    ([(40, 104, 98, 101, False), (20, 103, 99, 100, False)], "LATE"),
    ([(40, 104, 98, 101, False), (20, 105, 99, 100, False)], "CONFLICT:LATE_RANGE"),
    ([(40, 104, 98, 101, False), (20, 103, 99, 100, True)], "CONFLICT:LATE_CLOSED"),
])
def test_conflicts_and_late_arrivals(spark, states, expected):
    assert outcomes(spark, states) == ["INSERTED", expected]


def test_observations_must_exist_and_be_of_the_session(spark):
    state = [(20, 103, 99, 101, False)]
    assert outcomes(spark, state, [("other", "s1", at(20))]) == ["CONFLICT:MISSING_OBSERVATION"]
    assert outcomes(spark, state, [("o0", "s2", at(20))]) == ["CONFLICT:OTHER_SESSION"]


def test_conflict_leaves_the_state(spark):
    assert outcomes(spark, [(20, 104, 99, 101, False), (40, 103, 99, 101, False), (60, 105, 99, 102, False)])[2] == "EVOLVED"


def test_audits(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.5, 1.5), (1.0, 0.9, 0.5, 0.8), (1.0, 2.0, 1.2, 1.5), (None, 2.0, 0.0, 1.0)], "open double, high double, low double, close double")
    assert sorted(r.violation for r in schema.violations(df, schema.ohlc_rules()).collect()) == ["HIGH_BELOW_BODY", "LOW_ABOVE_BODY"]
    keys = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert [tuple(r) for r in schema.duplicate_keys(keys, ["k"]).collect()] == [(1, 2)]
    assert [r.k for r in schema.orphans(keys, spark.createDataFrame([(1,)], "k int"), ["k"]).collect()] == [2]


def test_save_candles_folds_and_appends(spark, filled):
    """One call folds arrivals into what is stored, writes snapshots, and moves the canonical candle on."""
    filled.append("observations", spark.createDataFrame([(f"o{i}", "s1", at(20 + i), "f1", 0.9, 0.95) for i in range(5)], schema.SCHEMAS["observations"]))

    def arrivals(*rows):
        return spark.createDataFrame([("s1", BASE, i, o, "vision", "TEST", "1m", BASE + timedelta(minutes=1), 100.0, float(h), float(lo), float(c), closed, 0.9, None) for i, (o, h, lo, c, closed) in enumerate(rows)], ARRIVAL)

    assert [r.outcome for r in filled.save_candles(arrivals(("o0", 101, 99, 100, False), ("o2", 103, 98, 102, False))).orderBy("arrival").collect()] == [store.INSERTED, store.EVOLVED]
    assert [r.outcome for r in filled.save_candles(arrivals(("o0", 101, 99, 100, False), ("o1", 102, 99, 101, False))).orderBy("arrival").collect()] == [store.LATE, store.LATE]
    assert filled.read("snapshots").count() == 3 and [float(r.high) for r in filled.candles().collect()] == [103]
    with pytest.raises(store.Conflict, match="o3: RANGE_SHRANK"):
        filled.save_candles(arrivals(("o4", 104, 97, 103, True), ("o3", 102, 98, 100, False)).withColumn("arrival", 5 - F.col("arrival")))
    assert filled.read("snapshots").count() == 3
    with pytest.raises(store.Conflict, match="MISSING_OBSERVATION"):
        filled.save_candles(arrivals(("o9", 104, 97, 103, True)))
    filled.save_candles(arrivals(("o4", 104, 97, 103, True)))
    assert [(float(r.high), r.is_closed) for r in filled.candles().collect()] == [(104, True)]


def test_analyze_and_record(spark, filled):
    from decimal import Decimal

    from wickline.config import AnalysisConfig
    from wickline.operators import classify

    rows = [("s1", BASE + timedelta(minutes=i), BASE + timedelta(minutes=i + 1), i, 10.0 + i, 12.0 + i, 9.0 + i, 11.0 + i, True, 0.9) for i in range(5)]
    snapshots = spark.createDataFrame(rows, "session_id string, open_time timestamp, ts timestamp, seq long, open double, high double, low double, close double, is_closed boolean, confidence double")
    requests = spark.createDataFrame([("a1", "s1", BASE + timedelta(minutes=10)), ("a2", "s1", BASE + timedelta(minutes=2))], "analysis_id string, session_id string, as_of timestamp")
    config = AnalysisConfig(2, 3, Decimal("0.1"), 0.5)
    classify.analyze_and_record(filled, snapshots, requests, config)
    classify.analyze_and_record(filled, snapshots, requests, config)
    assert filled.read("analyses").count() == 2
    one, two = filled.get("analyses", analysis_id="a1"), filled.get("analyses", analysis_id="a2")
    assert (one["market_state"], one["timestamp"].replace(tzinfo=None) is not None, one["data_quality"]) == ("UP", True, 0.9)
    assert two["market_state"] == "UNCERTAIN" and two["evidence"][0] == "STATE_RULE=INSUFFICIENT_HISTORY" and two["data_quality"] is None
    with pytest.raises(store.Conflict):
        classify.analyze_and_record(filled, snapshots.withColumn("confidence", F.lit(0.8)), requests.where("analysis_id = 'a1'"), config)


def observation(spark, name, confidence=0.9):
    return spark.createDataFrame([(name, "s1", at(20), "f1", confidence, 0.95)], schema.SCHEMAS["observations"])


def test_two_writers_with_other_rows_both_win(spark, filled):
    """The second writer commits between the first one's plan and its own commit."""
    other = store.Store(spark, filled.path)
    calls = []

    def work(view):
        calls.append(view.state.version)
        inserted = view.append("observations", observation(spark, "o1"))
        if len(calls) == 1:
            other.append("observations", observation(spark, "o2"))
        return inserted

    assert filled.commit(work) == 1 and len(calls) == 2  # done again on the new version
    assert sorted(r.observation_id for r in filled.read("observations").collect()) == ["o1", "o2"]


def test_two_writers_of_one_row_do_not_both_win(spark, filled):
    other = store.Store(spark, filled.path)

    def work(view):
        inserted = view.append("observations", observation(spark, "o1", 0.8))
        if not filled.read("observations").count():
            other.append("observations", observation(spark, "o1", 0.9))
        return inserted

    with pytest.raises(store.Conflict):
        filled.commit(work)
    assert [r.confidence for r in filled.read("observations").collect()] == [0.9]


def test_writers_of_other_tables_do_not_wait(spark, filled):
    calls = []

    def work(view):
        calls.append(1)
        out = view.append("analyses", spark.createDataFrame([("a", "s1", at(1), "UP", 0.5, None, ["x"])], schema.SCHEMAS["analyses"]))
        store.Store(spark, filled.path).append("observations", observation(spark, f"o{len(calls)}"))
        return out

    assert filled.commit(work) == 1 and calls == [1]
    assert filled.read("analyses").count() == filled.read("observations").count() == 1


def test_a_failed_commit_leaves_nothing(spark, filled, tmp_path):
    """Observations and snapshots are saved together, and the second write fails."""
    before, version = filled.log.state(), filled.log.state().version
    rows = spark.createDataFrame([("s1", BASE, 0, "o1", "vision", "TEST", "1m", BASE + timedelta(minutes=1), 100.0, 101.0, 99.0, 100.0, False, 0.9, None)], ARRIVAL)

    def fails(table, df, write=filled.write):
        if table == "snapshots":
            raise RuntimeError("disk full")
        return write(table, df)

    filled.write = fails
    with pytest.raises(RuntimeError, match="disk full"):
        filled.save_candles(rows, observation(spark, "o1"))
    del filled.write
    assert filled.log.state() == before and filled.read("observations").count() == 0
    import os
    assert not os.listdir(f"{filled.path}/observations")  # its files are gone too
    with pytest.raises(store.Conflict, match="OTHER_SESSION"):
        filled.append("sessions", spark.createDataFrame([("s2", *SESSION[1:])], schema.SCHEMAS["sessions"]))
        filled.append("frames", spark.createDataFrame([("f2", "s2", at(20), "hash", 8, 5, True, None)], schema.SCHEMAS["frames"]))
        filled.save_candles(rows, spark.createDataFrame([("o1", "s2", at(20), "f2", 0.9, 0.95)], schema.SCHEMAS["observations"]))
    assert filled.read("observations").count() == 0
    assert [r.outcome for r in filled.save_candles(rows, observation(spark, "o1")).collect()] == [store.INSERTED]
    assert (filled.read("observations").count(), filled.read("snapshots").count()) == (1, 1)
    assert filled.read("observations", version).count() == 0  # as it was


def test_the_log_is_summed_up(spark, filled, monkeypatch):
    monkeypatch.setattr(store.commits, "WHOLE", 3)
    for i in range(5):
        filled.append("observations", observation(spark, f"o{i}"))
    assert filled.read("observations").count() == 5 and filled.read("sessions").count() == 1
    assert filled.log.entry(6)["whole"] and filled.log.state(4).folders["observations"] == filled.log.state().folders["observations"][:2]
    assert not filled.log.publish(3, schema.VERSION, {}, [])  # taken


def test_migrations_up_down_and_up(spark, filled):
    from wickline.operators import migrations

    filled.append("observations", observation(spark, "o1"))
    evidence = ['STATE_RULE="X"', "ü, [1]", ""]
    filled.append("analyses", spark.createDataFrame([("a1", "s1", at(1), "UP", 0.5, None, evidence), ("a2", "s1", at(2), "DOWN", 0.5, 0.25, [])], schema.SCHEMAS["analyses"]))
    tables = ("sessions", "frames", "observations", "analyses")
    rows = {t: sorted(map(str, filled.read(t).collect())) for t in tables}
    assert migrations.downgrade(filled, 5) == 7
    with pytest.raises(ValueError, match="version 5, not 7"):
        filled.read("analyses")
    with pytest.raises(ValueError, match="version 5"):
        filled.append("observations", observation(spark, "o2"))
    stored = spark.read.parquet(*filled.log.state().folders["analyses"])
    assert dict(stored.dtypes)["evidence"] == "string" and migrations.schema_at("analyses", 5)["evidence"].dataType.simpleString() == "string"
    assert migrations.upgrade(filled) == 5
    assert {t: sorted(map(str, filled.read(t).collect())) for t in tables} == rows
    migrations.downgrade(filled, 2)
    migrations.upgrade(filled)
    assert [filled.read(t).count() for t in tables] == [1, 1, 0, 0]  # later tables were dropped and are empty
    with pytest.raises(ValueError, match="below"):
        migrations.downgrade(filled, 9)
    with pytest.raises(ValueError, match="no table outcomes"):
        migrations.schema_at("outcomes", 6)


def test_an_old_store_is_brought_up_from_nothing(spark, tmp_path):
    from wickline.operators import migrations

    s = store.Store(spark, str(tmp_path / "old"))
    migrations.upgrade(s, 3)
    with pytest.raises(ValueError, match="version 3"):
        s.read("sessions")
    migrations.upgrade(s)
    assert s.append("sessions", spark.createDataFrame([SESSION], schema.SCHEMAS["sessions"])) == 1

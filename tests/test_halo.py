"""Windows in buckets against windows over whole series, and as-of joins against plain loops."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wickline.operators import asof, features, halo

from .conftest import BASE


@pytest.fixture(scope="module")
def series(spark):
    """Candles of sessions with busy and empty days; some columns clash with names used inside."""
    rng, rows = random.Random(5), []
    for session, gap in (("busy", 40), ("sparse", 60 * 31), ("one", 0)):
        at = BASE
        for _ in range(1 if session == "one" else 90):
            low = rng.choice([0.0, 1.0, 2.0, 3.0])
            rows.append((session, at, low + rng.random(), low + 2, low, low + rng.random() if rng.random() < 0.9 else 0.0, rng.random() < 0.9, rng.choice([0.5, 0.9, None]), "clash"))
            at += timedelta(minutes=rng.randrange(1, 2 + 2 * gap))
    df = spark.createDataFrame(rows, "session_id string, open_time timestamp, open double, high double, low double, close double, is_closed boolean, confidence double, _bucket string")
    return df.withColumns({"_copied": F.lit(1), "_rank": F.lit(2), "_ends": F.lit(3)}).persist()


def same(a, b):
    key = lambda r: (r.session_id, r.open_time)
    left, right = sorted(a.collect(), key=key), sorted(b.select(*a.columns).collect(), key=key)
    return left == right and len(left) > 0


@pytest.mark.parametrize("unit", ["hour", "day", "year"])
def test_features_in_buckets(series, unit):
    by = ["session_id"]
    for call in (
        lambda b: features.pairwise(series, by, bucket=b),
        lambda b: features.structural(series, by, volatility=9, trend=3, lateral=(5, 2.0), quality=4, count=True, bucket=b),
        lambda b: features.structural(series, by, trend=40, bucket=b),
    ):
        assert same(call(unit), call(None))


@pytest.mark.parametrize("reach", [1, 2, 7, 200])
def test_rows_behind(series, reach):
    add = lambda df, w: df.withColumn("next", F.lead("open", reach).over(w)).withColumn("before", F.lag("open", 2).over(w))
    assert same(halo.over(series, ["session_id"], "open_time", add, before=2, after=reach), add(series, Window.partitionBy("session_id").orderBy("open_time")))


def test_places_are_counted_over_buckets(series):
    w = Window.partitionBy("session_id").orderBy("open_time")
    assert same(halo.numbered(series, ["session_id"], ["open_time"], "place"), series.withColumn("place", F.row_number().over(w)))


def test_numbers_fall_into_buckets(spark):
    df = spark.createDataFrame([("s", i * 30_000) for i in range(-5, 9)], "session_id string, open_time long")
    add = lambda df, w: df.withColumn("before", F.lag("open_time", 3).over(w))
    assert same(halo.over(df, ["session_id"], "open_time", add, before=3), add(df, Window.partitionBy("session_id").orderBy("open_time")))


def test_no_session_is_the_only_key_over_candles(spark):
    from wickline.plans.queries import QUERIES

    for name in ("volatility", "basic_trend", "basic_lateralization", "data_quality", "returns", "outcome_horizon"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        keys = [[c.split("#")[0].strip() for c in part.split(" ASC")[0].split(" DESC")[0].split(",")] for part in plan.split("windowspecdefinition(")[1:]]
        assert any("_bucket" in k and "open_time" in k for k in keys) and ["session_id", "open_time"] not in keys


@pytest.mark.parametrize("unit", ["hour", "day", "year"])
def test_last_known_against_a_loop(spark, unit):
    rng = random.Random(6)
    left = [(rng.choice("ab"), BASE + timedelta(minutes=rng.randrange(-3000, 9000, 20)), i) for i in range(120)] + [("c", BASE, 120), ("a", None, 121)]
    right = [(rng.choice("abd"), BASE + timedelta(minutes=rng.randrange(0, 6000, 20)), i, rng.choice([None, 1.0, 2.0])) for i in range(60)]
    one = spark.createDataFrame(left, "session_id string, t timestamp, _row long")
    two = spark.createDataFrame(right, "session_id string, t timestamp, n long, v double")
    got = {r._row: (r.n, r.v) for r in asof.last_known(one, two, ["session_id"], "t", "t", ["n", "v"], tie=["n"], bucket=unit).collect()}
    for session, t, i in left:
        known = [(r[1], r[2], r[3]) for r in right if t is not None and r[0] == session and r[1] <= t]
        best = max(known, key=lambda r: r[:2], default=None)
        assert got[i] == ((best[1], best[2]) if best else (None, None))


def test_an_impossible_confidence_fails(spark, minute):
    for values in ([0.5, 1.5, None], [0.5, -0.1, 0.5], [0.5, float("nan"), None]):
        df = spark.createDataFrame([("s", minute(i), v) for i, v in enumerate(values)], "session_id string, open_time timestamp, confidence double")
        with pytest.raises(Exception, match="confidence must be from 0 to 1"):
            features.quality(df, ["session_id"], 3).collect()
    fine = spark.createDataFrame([("s", minute(i), v) for i, v in enumerate([1.0, 0.0, None, 0.5])], "session_id string, open_time timestamp, confidence double")
    assert [r.quality for r in features.quality(fine, ["session_id"], 2).orderBy("open_time").collect()] == [None, 0.0, None, None]

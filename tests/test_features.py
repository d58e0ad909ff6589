from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from wickline.functions import exact, registry
from wickline.operators import features

BY = ["session_id"]


def series(spark, minute, rows):
    """Rows of (high, low, close[, closed])."""
    data = [("s", minute(i), float(r[2]), float(r[0]), float(r[1]), float(r[2]), r[3] if len(r) > 3 else True, 0.9) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "session_id string, open_time timestamp, open double, high double, low double, close double, is_closed boolean, confidence double")


def closes(spark, minute, values):
    return series(spark, minute, [(v, v, v) if not isinstance(v, tuple) else (v[0], v[0], v[0], v[1]) for v in values])


def last(df, name):
    return df.orderBy(F.desc("open_time")).first()[name]


@pytest.mark.parametrize("values, expected", [((100, 110, 99), 0.10), ((100, 110, 121), 0.0), ((50, 100, 110, 99), 0.10), ((100, 110, 99, (500, False)), 0.10), ((0, 10, 11), None), ((100, 110), None)])
def test_volatility_of_three(spark, minute, values, expected):
    found = last(features.volatility(features.closed_only(closes(spark, minute, values)), BY, 3), "volatility")
    assert found is None if expected is None else abs(found - expected) < 1e-12


@pytest.mark.parametrize("pairs, rows, expected", [
    (2, [(105, 95), (106, 96), (107, 97)], "RISING_STRUCTURE"), (2, [(105, 95), (104, 94), (103, 93)], "FALLING_STRUCTURE"),
    (1, [(105, 95), (107, 93)], "MIXED_STRUCTURE"), (2, [(105, 95), (106, 96)], None),
])
def test_trend(spark, minute, pairs, rows, expected):
    assert last(features.trend(series(spark, minute, [(h, lo, (h + lo) / 2) for h, lo in rows]), BY, pairs), "trend") == expected


@pytest.mark.parametrize("limit, expected", [(0.01, True), (0.009, False)])
def test_lateral_is_inclusive(spark, minute, limit, expected):
    assert last(features.lateral(series(spark, minute, [(100.5, 99.5, 100)] * 3), BY, 3, limit), "lateral") is expected


def test_lateral_needs_a_first_close(spark, minute):
    assert last(features.lateral(series(spark, minute, [(1, 0, 0), (1, 0, 1), (1, 0, 1)]), BY, 3, 5.0), "lateral") is None


def test_pairwise_nulls_where_a_side_is_open(spark, minute):
    rows = features.pairwise(closes(spark, minute, [3, (4, False), 5]), BY).orderBy("open_time").collect()
    assert abs(rows[1]["return"] - 1 / 3) < 1e-12 and rows[1]["higher_high"] is None
    assert rows[2]["return"] is None and rows[2]["higher_low"] is None and rows[0]["direction"] == "CLOSE_EQUAL_OPEN"


def test_parameters_are_checked(spark, minute):
    df = closes(spark, minute, [1, 2, 3])
    for call in (lambda: features.volatility(df, BY, 2), lambda: features.trend(df, BY, 0), lambda: features.lateral(df, BY, 2, 1), lambda: features.lateral(df, BY, 3, -1), lambda: features.trend(df, BY, True)):
        with pytest.raises(ValueError):
            call()


def test_exact_digits_whatever_the_context(spark, minute):
    with localcontext() as context:
        context.prec = 4
        assert str(exact.change(Decimal(4), Decimal(3))) == "0.3333333333333333333333333333"
        assert str(exact.deviation([Decimal(3), Decimal(4), Decimal(5)])) == "0.04166666666666666666666666665"
    df = exact.volatility(closes(spark, minute, [3, 4, 5]), BY, 3)
    assert str(last(df, "volatility_exact")) == "0.041666666666666666666666666650"
    inside = spark.createDataFrame([(5.123456789, 3.000000001, 3.5)], "h double, l double, c double").select(exact.within_range(F.col("h"), F.col("l"), F.col("c"), Decimal("0.6068")).alias("x"))
    assert inside.first()["x"] is True


def test_sql_functions(spark):
    names = registry.register(spark)
    assert "candle_direction" in names
    row = spark.sql("SELECT candle_direction(1, 2) a, candle_return(4, 0) b, basic_trend(false, true) c, basic_lateralization('MIXED_STRUCTURE', 2, 1, 10, 0.1) d, candle_amplitude(3, 1) e").first()
    assert tuple(row) == ("CLOSE_ABOVE_OPEN", None, "FALLING_STRUCTURE", True, 2.0)


def test_plain_text(spark):
    got = spark.sql("SELECT CAST(100.50 AS DECIMAL(10, 4)) a, CAST(100 AS DECIMAL(10, 0)) b, CAST(7 AS DECIMAL(10, 3)) c").select(*[exact.plain_text(F.col(c)) for c in "abc"]).first()
    assert tuple(got) == ("100.5", "100", "7")

"""Databases, truth files, chart series, and the text of numbers."""

import random
import struct
from datetime import timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from wickline.functions import texts
from wickline.operators import replay
from wickline.operators.store import Conflict
from wickline.sources import database, readers

from .conftest import BASE


@pytest.fixture(scope="module")
def derby(spark, tmp_path_factory):
    url = f"jdbc:derby:{tmp_path_factory.mktemp('derby') / 'db'};create=true"
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    connection.createStatement().executeUpdate('CREATE TABLE candles ("id" BIGINT NOT NULL PRIMARY KEY, "asset" VARCHAR(20), "close" DECIMAL(30, 10), "at" TIMESTAMP)')
    connection.close()
    return url


def rows(spark, ids, price="1.5", asset="A"):
    return spark.createDataFrame([(i, asset if i % 3 else None, Decimal(price) + i, BASE + timedelta(minutes=i)) for i in ids], "id long, asset string, close decimal(30,10), at timestamp")


def test_inserts_are_idempotent_and_reads_divided(spark, derby):
    df = rows(spark, range(100)).repartition(3)
    assert database.insert(df, derby, "candles", ["id"]) == 100
    assert database.insert(df.union(df), derby, "candles", ["id"]) == 0
    assert database.insert(rows(spark, range(90, 110)), derby, "candles", ["id"]) == 10
    got = database.read_table(spark, derby, "candles", by="id", partitions=4)
    assert got.rdd.getNumPartitions() == 4 and all(n > 0 for n in got.groupBy(F.spark_partition_id()).count().rdd.map(lambda r: r[1]).collect())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows(spark, range(110)).collect()))
    assert database.read_table(spark, derby, "candles", by="at", partitions=3).count() == 110


def test_contradictions_are_refused_whole(spark, derby):
    before = database.read_table(spark, derby, "candles").count()
    stored = rows(spark, [5001])
    database.insert(stored, derby, "candles", ["id"])
    for bad in (rows(spark, [5001, 5002], price="9"), stored.withColumn("asset", F.lit("B")).union(rows(spark, [5003])), rows(spark, [5004]).union(rows(spark, [5004], price="7"))):
        with pytest.raises(Conflict):
            database.insert(bad, derby, "candles", ["id"])
    assert database.read_table(spark, derby, "candles").count() == before + 1
    tables = spark.read.format("jdbc").options(url=derby, query="SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLETYPE = 'T'").load()
    assert [r[0] for r in tables.collect()] == ["CANDLES"]  # no stage is left


def test_a_table_without_a_range_is_read_whole(spark, derby):
    connection = spark._jvm.java.sql.DriverManager.getConnection(derby)
    connection.createStatement().executeUpdate('CREATE TABLE bare ("id" BIGINT)')
    connection.close()
    assert database.read_table(spark, derby, "bare", by="id").count() == 0


def test_truth_files(spark, tmp_path):
    (tmp_path / "truth.csv").write_text("timestamp,open,high,low,close\n2026-01-05T14:30:00Z,100.1,101,99.000000000000000001,100\n2026-01-05T14:31:00Z,100,,99,\n")
    one, two = readers.ground_truth_csv(spark, str(tmp_path / "truth.csv")).orderBy("timestamp").collect()
    assert (one.open, one.low, two.high, two.close) == (Decimal("100.1"), Decimal("99.000000000000000001"), None, None)


def test_chart_series(spark, minute):
    rows = [("s", minute(i), minute(i + 1), *map(Decimal, ("1.50", "2", "1", "1.25")), i < 2) for i in range(3)]
    df = spark.createDataFrame(rows, "session_id string, open_time timestamp, close_time timestamp, open decimal(38,18), high decimal(38,18), low decimal(38,18), close decimal(38,18), is_closed boolean")
    series = replay.chart_series(df).collect()
    assert len(series) == 3 and [float(series[0][c]) for c in ("open", "high", "low", "close")] == [1.5, 2, 1, 1.25]


def test_numbers_as_text(spark):
    rng = random.Random(7)
    values = [0.0, -0.0, 1.0, -1.0, 1e-5, 1e-4, 0.00012, 1e15, 1e16, 1.5e16, 123456789012345680.0, 1e22, 1e23, 2.0**-44, 5e-324, 1.7976931348623157e308, 0.1, 0.30000000000000004, 100.0, 1 / 3, float("nan"), float("inf"), float("-inf"), None, 9007199254740993.0, 2e-3]
    values += [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(5_000)] + [rng.random() * 10 ** rng.randrange(-8, 20) for _ in range(3_000)] + [round(rng.random(), rng.randrange(1, 9)) for _ in range(2_000)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v double").select("i", texts.float_text(F.col("v")).alias("t"))
    got = {r.i: r.t for r in df.collect()}
    wrong = [(v, got[i]) for i, v in enumerate(values) if got[i] != (None if v is None else str(v))]
    assert not wrong, wrong[:5]
    kinds = spark.range(1).select(texts.number_text(F.lit(Decimal("1.50"))).alias("a"), texts.number_text(F.lit(3)).alias("b"), texts.number_text(F.lit(1e-7)).alias("c")).first()
    assert tuple(kinds) == ("1.50", "3", "1e-07")

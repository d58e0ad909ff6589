"""Every query of the candle engine against its DuckDB form."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data is not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return connection


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(str(r[i]) for i in order) for r in found)


def names():
    from wickline.plans.oracle import ORACLE_SQL

    return sorted(ORACLE_SQL)


@pytest.mark.parametrize("name", names())
def test_matches_sql(spark, duck, name):
    from wickline.plans.oracle import ORACLE_SQL
    from wickline.plans.queries import QUERIES

    df = QUERIES[name](spark, SF)
    expected = duck.execute(ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in expected.description], expected.fetchall())


def test_entry_and_registration(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_are_pruned_and_native(spark):
    from wickline.plans.queries import QUERIES

    plan = QUERIES["analysis_dense"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """Events of which some have prices far above the usual pages of charts, and some below 0."""
    path = str(tmp_path_factory.mktemp("far"))
    with duckdb.connect() as connection:
        value = "CASE WHEN event_id % 97 = 5 THEN value + 700 WHEN event_id % 89 = 3 THEN -2 * value WHEN event_id % 997 = 1 THEN value + 1500 ELSE value END"
        connection.execute(f"COPY (SELECT * REPLACE ({value} AS value) FROM '{SF.removesuffix('0.001')}0.01/events.parquet') TO '{path}/events.parquet' (FORMAT parquet)")
    return path


@pytest.mark.parametrize("name", ["chart_prices", "chart_reading", "chart_regions", "touching_bars"])
def test_charts_hold_any_price(spark, far, name):
    from wickline.plans.oracle import ORACLE_SQL
    from wickline.plans.queries import QUERIES

    with duckdb.connect() as connection:
        connection.execute(f"CREATE VIEW events AS SELECT * FROM '{far}/events.parquet'")
        expected = connection.execute(ORACLE_SQL[name])
        wanted = rows([c[0] for c in expected.description], expected.fetchall())
    df = QUERIES[name](spark, far)
    assert rows(df.columns, df.collect()) == wanted

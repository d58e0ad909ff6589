"""A database's tables: reads divided by a column, and idempotent writes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wickline.operators.store import Conflict


def read_table(spark: SparkSession, url: str, table: str, by: str | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table over JDBC; ``by`` is a number, date or time whose range is asked of the table and divided among ``partitions`` queries.

    Rows with a null or at the rim go to the first and last one.  A table
    without a range is read by one query.  The driver must be on the class path.
    """
    def load(what: str, **more) -> DataFrame:
        return spark.read.format("jdbc").options(url=url, dbtable=what, **options, **more).load()

    if by is None:
        return load(table)
    name = _quote(spark, url, by)
    low, high = load(f"(SELECT min({name}) AS low, max({name}) AS high FROM {table}) bounds").first()
    if low is None or low == high:
        return load(table)
    return load(table, partitionColumn=by, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions))


def insert(df: DataFrame, url: str, table: str, keys: list[str], **options: str) -> int:
    """Insert the rows that the table does not have and return their number.

    Rows are written to a stage beside the table by many tasks, which may be
    repeated, and merged by key in one transaction.  Equal rows are one row; a row that
    contradicts a stored one, or another of its key, refuses them all with
    :class:`~wickline.operators.store.Conflict`.
    """
    spark, stage = df.sparkSession, f"{table}_{uuid.uuid4().hex[:12]}"
    names = {c: _quote(spark, url, c) for c in df.columns}
    columns, rest = ", ".join(names.values()), [names[c] for c in df.columns if c not in keys]
    same = " AND ".join(f"t.{names[k]} = s.{names[k]}" for k in keys)
    # a text of the stage is of the widest kind, which some databases do not compare
    differs = " OR ".join(f"t.{c} <> s.{c} OR (t.{c} IS NULL AND s.{c} IS NOT NULL) OR (t.{c} IS NOT NULL AND s.{c} IS NULL)" for c in rest)
    by = ", ".join(names[k] for k in keys)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        statement = connection.createStatement()
        held = statement.executeQuery(f"SELECT {columns} FROM {table} WHERE 1 = 0").getMetaData()
        kinds = [(held.getColumnTypeName(i), held.getPrecision(i)) for i in range(1, len(names) + 1)]
        cast = ", ".join(f"CAST({name} AS {kind}({size})) AS {name}" if "CHAR" in kind else name for name, (kind, size) in zip(names.values(), kinds))
        df.write.format("jdbc").options(url=url, dbtable=stage, **options).mode("error").save()
        try:
            connection.setAutoCommit(False)

            def count(query: str) -> int:
                found = statement.executeQuery(query)
                found.next()
                return found.getLong(1)

            distinct = f"(SELECT DISTINCT {columns} FROM (SELECT {cast} FROM {stage}) x)"
            twice = count(f"SELECT count(*) FROM (SELECT {by} FROM {distinct} d GROUP BY {by} HAVING count(*) > 1) y")
            other = count(f"SELECT count(*) FROM {distinct} s JOIN {table} t ON {same} WHERE {differs}") if rest else 0
            if twice or other:
                raise Conflict(f"{twice + other} rows of {table} contradict others")
            inserted = statement.executeUpdate(f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {distinct} s WHERE NOT EXISTS (SELECT 1 FROM {table} t WHERE {same})")
            connection.commit()
            return inserted
        finally:
            connection.rollback() if not connection.getAutoCommit() else None
            connection.setAutoCommit(True)
            statement.executeUpdate(f"DROP TABLE {stage}")
    finally:
        connection.close()


def _quote(spark: SparkSession, url: str, name: str) -> str:
    """A column's name as the database wants it quoted."""
    return spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(name)

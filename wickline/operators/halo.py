"""Windows over a few neighbours without a whole series as their key.

The rows of a series are dealt into buckets of time, and the rows that a window
reaches beyond its bucket are copied in from the buckets beside.  What is carried
from bucket to bucket is the small table of their last (or first) rows, so that a
busy series is spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

#: Width of a bucket of times that are numbers: a day of seconds.
NUMBERS = 86_400


def fresh(base: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    held = {c.lower() for df in frames for c in df.columns}
    while base in held:
        base += "_"
    return base


def bucket_of(df: DataFrame, column: str, bucket: str) -> Column:
    """The bucket of a row: its day (or another unit of time), or a stretch of ``NUMBERS``."""
    dated = isinstance(df.schema[column].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    return F.date_trunc(bucket, column) if dated else F.floor(F.col(column) / NUMBERS)


def beside(df: DataFrame, by: list[str], order: str, before: int, after: int, bucket: str = "day") -> tuple[DataFrame, str, str]:
    """(rows with their bucket and copies of up to ``before`` rows before and ``after`` rows behind it, name of the bucket, name of the mark of copies).

    Rows of ``by`` are in the order of ``order``, which is unique within it.
    """
    at, copy, rank, ends, n, start, held = (fresh(f"_{x}", df) for x in ("bucket", "copied", "rank", "ends", "rows", "start", "held"))
    keys = [*by, at]
    rows = df.withColumn(at, bucket_of(df, order, bucket))
    copies = []
    for reach, forward in ((before, True), (after, False)):
        if not reach:
            continue
        nearest = F.desc(order) if forward else F.asc(order)
        ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(nearest)))
        row = F.struct(F.col(order).alias("_0"), F.struct(*df.columns).alias("_1"))
        end = ranked.groupBy(*keys).agg(F.count("*").alias(n), F.array_sort(F.collect_list(F.when(F.col(rank) <= reach, row)), lambda a, b: F.when(a["_0"] < b["_0"], -1).when(a["_0"] > b["_0"], 1).otherwise(0)).alias(ends))
        along = Window.partitionBy(*by).orderBy(F.asc(at) if forward else F.desc(at))
        # a bucket begins after ``start`` rows; the one passed before it ends there, and its end rows are held by the bucket that follows
        table = end.withColumns({start: F.coalesce(F.sum(n).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), held: F.lag(ends).over(along)})
        near = F.collect_list(held).over(Window.partitionBy(*by).orderBy(start).rangeBetween(-(reach - 1), 0))
        gathered = table.select(*keys, F.flatten(near if forward else F.reverse(near)).alias(held))
        taken = F.slice(held, F.greatest(F.lit(1), F.size(held) - reach + 1), F.lit(reach)) if forward else F.slice(held, 1, reach)
        copies.append(gathered.select(at, F.explode(taken).alias(held)).select(f"{held}._1.*", at).withColumn(copy, F.lit(True)))
    out = rows.withColumn(copy, F.lit(False))
    for more in copies:
        out = out.unionByName(more)
    return out, at, copy


def over(df: DataFrame, by: list[str], order: str, add: Callable[[DataFrame, WindowSpec], DataFrame], before: int = 0, after: int = 0, bucket: str | None = "day") -> DataFrame:
    """``add(rows, window)`` over windows that reach ``before`` rows back and ``after`` forward.

    Without a ``bucket`` the series is not divided, which is for small ones.
    """
    if bucket is None:
        return add(df, Window.partitionBy(*by).orderBy(order))
    rows, at, copy = beside(df, by, order, before, after, bucket)
    return add(rows, Window.partitionBy(*by, at).orderBy(order)).where(~F.col(copy)).drop(at, copy)


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, bucket: str = "day") -> DataFrame:
    """``name``: the place of each row within ``by``, from 1; places within a bucket are added to the counts of those before."""
    at, n = fresh("_bucket", df), fresh("_rows", df)
    rows = df.withColumn(at, bucket_of(df, order[0], bucket))
    earlier = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    table = rows.groupBy(*by, at).agg(F.count("*").alias(n)).withColumn(n, F.coalesce(F.sum(n).over(earlier), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*by, at).orderBy(*order))
    return rows.withColumn(name, place).join(table, [*by, at]).withColumn(name, (F.col(name) + F.col(n)).cast("int")).select(*df.columns, name)

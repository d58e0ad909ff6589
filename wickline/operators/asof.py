"""Point-in-time reads: what was known at an instant, never later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wickline.operators import halo

BUCKET = ["session_id", "open_time"]
KNOWN = ["ts", "seq"]


def as_of(snapshots: DataFrame, instant, session_id: str | None = None) -> DataFrame:
    """The latest snapshot of each candle with knowledge time <= ``instant``; ties to the greater seq."""
    known = snapshots.where(F.col("ts") <= F.lit(instant))
    if session_id is not None:
        known = known.where(F.col("session_id") == session_id)
    rank, name = F.row_number().over(Window.partitionBy(*BUCKET).orderBy(*[F.desc(c) for c in KNOWN])), halo.fresh("_rank", known)
    return known.withColumn(name, rank).where(F.col(name) == 1).drop(name)


def validity(snapshots: DataFrame) -> DataFrame:
    """Snapshots with [valid_from, valid_to): when each was the latest; ties leave the earlier one no time."""
    nxt = F.lead("ts").over(Window.partitionBy(*BUCKET).orderBy(*KNOWN))
    return snapshots.withColumns({"valid_from": F.col("ts"), "valid_to": nxt})


def _days(snapshots: DataFrame) -> DataFrame:
    """Per session and day of candles: when the first was known, when the last changed, and how many ended closed."""
    candles = snapshots.groupBy("session_id", "open_time").agg(F.max_by("is_closed", F.struct(*KNOWN)).alias("closed"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return candles.groupBy("session_id", F.date_trunc("day", "open_time").alias("_day")).agg(F.min("first").alias("_first"), F.max("last").alias("_settled"), F.count_if("closed").alias("_closed"))


def _known_then(snapshots: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (session_id, as_of, _day) with the candles of that day as they were known."""
    valid = validity(snapshots).withColumn("_day", F.date_trunc("day", "open_time"))
    inside = (F.col("valid_from") <= F.col("as_of")) & (F.col("valid_to").isNull() | (F.col("as_of") < F.col("valid_to")))
    return requests.join(valid, ["session_id", "_day"]).where(inside).drop("valid_from", "valid_to", "_day")


def as_of_many(snapshots: DataFrame, requests: DataFrame) -> DataFrame:
    """The as-of read of every request (session_id, as_of): all its candles, with the request's columns.

    A request meets the snapshots day by day, of the days that were known by then,
    so that a busy session is spread over its days.
    """
    days = snapshots.groupBy("session_id", F.date_trunc("day", "open_time").alias("_day")).agg(F.min("ts").alias("_first"))
    return _known_then(snapshots, requests.join(days, "session_id").where(F.col("_first") <= F.col("as_of")).drop("_first"))


def recent_closed(snapshots: DataFrame, requests: DataFrame, n: int) -> DataFrame:
    """The last ``n`` closed candles of the as-of read of every request (session_id, as_of).

    Days are taken back from the newest until those that have not changed since
    the request's day began hold ``n`` closed candles; older days cannot have a
    part in the result and are not met.
    """
    asked = requests.select("session_id", F.date_trunc("day", "as_of").alias("_asked")).distinct()
    near = asked.join(_days(snapshots), "session_id").where(F.col("_first") < F.col("_asked") + F.expr("INTERVAL 1 DAY"))
    newer = Window.partitionBy("session_id", "_asked").orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    enough = F.sum(F.when(F.col("_settled") < F.col("_asked"), F.col("_closed")).otherwise(0)).over(newer)
    near = near.withColumn("_newer", F.coalesce(enough, F.lit(0))).where(F.col("_newer") < n).select("session_id", "_asked", "_day")
    placed = requests.withColumn("_asked", F.date_trunc("day", "as_of")).join(near, ["session_id", "_asked"]).drop("_asked")
    return last_n(_known_then(snapshots, placed).where("is_closed"), n, ["session_id", "as_of"])


def last_known(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, columns: list[str], tie: list[str] | None = None, bucket: str = "day") -> DataFrame:
    """Backward as-of join: each left row with ``columns`` of the last right row of ``by`` at or before it.

    Both sides are merged into timelines of one ``bucket`` of time each, so that a
    busy key is spread over its buckets.  The last right row of every bucket
    is carried over the small table of both sides' buckets and opens the timelines
    behind it; within a timeline the last right row is carried forward.  No pair
    but the result's is made; of the left side, the table of buckets needs keys
    and times alone.  Rows without a partner have nulls.  Times that are
    numbers fall into buckets of ``halo.NUMBERS``.
    """
    t, side, at, row, last = (halo.fresh(f"_{x}", left, right) for x in ("t", "side", "bucket", "row", "last"))
    spare = [halo.fresh(f"_tie{i}", left, right) for i in range(len(tie or []))]
    kinds = [right.schema[c].dataType for c in tie or []]
    one = left.withColumn(at, halo.bucket_of(left, left_time, bucket))
    two = right.select(*by, F.col(right_time).alias(t), halo.bucket_of(right, right_time, bucket).alias(at), *[F.col(c).alias(s) for c, s in zip(tie or [], spare)], F.struct(*columns).alias(last))
    ends = two.groupBy(*by, at).agg(F.max_by(last, F.struct(t, *spare)).alias(last))
    marks = one.select(*by, at).distinct().withColumn(side, F.lit(1)).unionByName(ends.withColumn(side, F.lit(0)), allowMissingColumns=True)
    # a bucket's own end stands behind its mark of the left side, and so opens later buckets alone
    earlier = Window.partitionBy(*by).orderBy(at, F.desc(side)).rowsBetween(Window.unboundedPreceding, -1)
    opening = marks.withColumn(last, F.last(last, ignorenulls=True).over(earlier)).where((F.col(side) == 1) & F.col(last).isNotNull()).withColumn(side, F.lit(-1))
    one = one.select(*by, F.col(left_time).alias(t), F.lit(1).alias(side), at, F.struct(*left.columns).alias(row), *[F.lit(None).cast(kind).alias(c) for c, kind in zip(spare, kinds)])
    line = one.unionByName(two.withColumn(side, F.lit(0)), allowMissingColumns=True).unionByName(opening, allowMissingColumns=True)
    within = Window.partitionBy(*by, at).orderBy(F.col(t).asc_nulls_first(), side, *spare).rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn(last, F.last(last, ignorenulls=True).over(within)).where(F.col(side) == 1).select(f"{row}.*", *[F.col(f"{last}.{c}").alias(c) for c in columns])


def carried(df: DataFrame, by: list[str], time: str, tie: list[str], value: str, name: str, bucket: str = "day") -> DataFrame:
    """``name``: the last ``value`` that is not null among the rows of ``by`` before each row.

    Rows are ordered within a ``bucket`` of time; what stands before a bucket is
    carried over the buckets, of which there is one row each.
    """
    in_, end = halo.fresh("_bucket", df), halo.fresh("_end", df)
    at = df.withColumn(in_, halo.bucket_of(df, time, bucket))
    ends = at.groupBy(*by, in_).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(time, *tie))).alias(end))
    earlier = Window.partitionBy(*by).orderBy(in_).rowsBetween(Window.unboundedPreceding, -1)
    opening = ends.withColumn(end, F.last(end, ignorenulls=True).over(earlier))
    before = Window.partitionBy(*by, in_).orderBy(time, *tie).rowsBetween(Window.unboundedPreceding, -1)
    out = at.join(opening, [*by, in_], "left").withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(before), F.col(end)))
    return out.select(*df.columns, name)


def candles_of_frames(snapshots: DataFrame, observations: DataFrame) -> DataFrame:
    """Candles as they were reconstructed for each frame, with its frame_id."""
    return snapshots.join(observations.select("observation_id", "frame_id"), "observation_id")


def candles_of_frame(snapshots: DataFrame, observations: DataFrame, frame_id: str) -> DataFrame:
    """Those of one frame, in order."""
    return candles_of_frames(snapshots, observations.where(F.col("frame_id") == frame_id)).drop("frame_id").orderBy("ts", "open_time")


def last_n(df: DataFrame, n: int, by: list[str], order: str = "open_time") -> DataFrame:
    """The last ``n`` rows of each group."""
    rank, name = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order))), halo.fresh("_rank", df)
    return df.withColumn(name, rank).where(F.col(name) <= n).drop(name)

"""Candles and snapshots from ticks, deduplication and coherence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wickline.config import timeframe_seconds
from wickline.operators import halo
from wickline.schema import ohlc_rules

BUCKET = ["session_id", "open_time"]


def floor_time(ts: Column, timeframe: str) -> Column:
    """Start of the timeframe's bucket since the epoch; floors before the epoch too."""
    seconds = timeframe_seconds(timeframe)
    s = F.unix_seconds(ts.cast("timestamp"))
    return F.timestamp_seconds(s - F.pmod(s, F.lit(seconds)))


def candles(ticks: DataFrame) -> DataFrame:
    """One OHLC row a bucket of ticks (session_id, open_time, ts, seq, price, confidence), with its first tick."""
    at = F.struct("ts", "seq")
    return ticks.groupBy(*BUCKET).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.when(F.count("confidence") == F.count("*"), F.min("confidence")).alias("confidence"), F.min("ts").alias("first_ts"), F.min_by("seq", at).alias("first_seq"), F.count("*").alias("ticks"),
    )


def snapshots(ticks: DataFrame) -> DataFrame:
    """What was known of each candle at each tick, and its closing state.

    A tick shows its bucket's candle open, with the values so far.  The first
    tick of the session's next bucket that is not empty shows it closed.  The
    cumulative windows are per bucket, and the candle that follows is looked for
    within a day and its successor, so a busy session is spread over its buckets.
    """
    so_far = Window.partitionBy(*BUCKET).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    growing = ticks.select(
        *BUCKET, "ts", "seq",
        F.first("price").over(so_far).alias("open"), F.max("price").over(so_far).alias("high"), F.min("price").over(so_far).alias("low"), F.col("price").alias("close"),
        F.lit(False).alias("is_closed"), F.when(F.count("confidence").over(so_far) == F.count("*").over(so_far), F.min("confidence").over(so_far)).alias("confidence"),
    )
    return growing.unionByName(closings(ticks))


def closings(ticks: DataFrame) -> DataFrame:
    """The snapshots that show a candle closed: one for each candle that another one follows."""
    found = halo.over(candles(ticks), ["session_id"], "open_time", lambda df, w: df.withColumns({"ts": F.lead("first_ts").over(w), "seq": F.lead("first_seq").over(w)}), after=1).where("seq is not null")
    return found.select(*BUCKET, "ts", "seq", "open", "high", "low", "close", F.lit(True).alias("is_closed"), "confidence")


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by ``order``, as one aggregation; the order must be unique within a key."""
    payload = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("row")).select(*keys, "row.*")


def keep_latest(tracked: DataFrame) -> DataFrame:
    """One row of each (session_id, open_time): the last seen, of ties the later arrival by ``arrival``."""
    return latest(tracked, BUCKET, "last_seen_at", "arrival")


def reject_reason() -> Column:
    """The first coherence rule that an OHLC row breaks, else null."""
    reason = F.lit(None).cast("string")
    for name, ok in reversed(ohlc_rules().items()):
        reason = F.when(~ok, name).otherwise(reason)
    return reason


def coherent(df: DataFrame, strict: bool = False) -> DataFrame:
    """Rows with coherent prices; ``strict`` fails on the first other one."""
    if strict:
        return df.where(F.when(reject_reason().isNull(), True).otherwise(F.raise_error(reject_reason()).cast("boolean")))
    return df.where(reject_reason().isNull())


def normalize(tracked: DataFrame, source_id: str, asset: str, timeframe: str) -> DataFrame:
    """Canonical candles from tracked ones."""
    if not all(x.strip() for x in (source_id, asset, timeframe)):
        raise ValueError("source_id, asset and timeframe must not be blank")
    return coherent(keep_latest(tracked), strict=True).select(
        "session_id", F.lit(source_id).alias("source_id"), F.lit(asset).alias("asset"), F.lit(timeframe).alias("timeframe"), "open_time", "close_time",
        "open", "high", "low", "close", "is_closed", F.col("confidence").alias("vision_confidence"), F.lit(None).cast("double").alias("source_confidence"),
    )


def bands(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Maximal runs of consecutive whole numbers per key, as (start, end)."""
    distinct = df.select(*keys, value).distinct()
    island = F.col(value) - F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    return distinct.withColumn("island", island).groupBy(*keys, "island").agg(F.min(value).alias("start"), F.max(value).alias("end")).drop("island")

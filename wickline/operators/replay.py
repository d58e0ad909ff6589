"""Replay: a virtual clock over closed candles."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from wickline.config import plain
from wickline.operators import asof, halo

IDLE, RUNNING, PAUSED, STOPPED, FINISHED = "idle", "running", "paused", "stopped", "finished"
MAX_ADVANCE_SECONDS = 3600


def visible(candles: DataFrame, clock) -> DataFrame:
    """Candles that have closed by the clock."""
    return candles.where(F.col("close_time") <= F.lit(clock))


def release_steps(candles: DataFrame, steps: DataFrame) -> DataFrame:
    """For clock readings (session_id, clock): how many candles each has released, and how many in all.

    The candles' running count is looked up at each reading, so readings and
    candles are merged, not paired.
    """
    counted = halo.numbered(candles.select("session_id", "close_time", "open_time"), ["session_id"], ["close_time", "open_time"], "position")
    found = asof.last_known(steps, counted, ["session_id"], "clock", "close_time", ["position"], tie=["open_time"]).withColumn("position", F.coalesce("position", F.lit(0)))
    return halo.over(found, ["session_id"], "clock", lambda df, w: df.withColumn("released", F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0))), before=1)


def sequence_violations(candles: DataFrame) -> DataFrame:
    """Rows (session_id, ordinal, asset, timeframe, open_time) that break a replay's order or mix series."""
    first = candles.groupBy("session_id").agg(F.min_by(F.struct("asset", "timeframe"), "ordinal").alias("_first"))

    def add(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("_before", F.lag("open_time").over(w))

    rows = halo.over(candles, ["session_id"], "ordinal", add, before=1).join(first, "session_id")
    broken = F.when(F.col("asset") != F.col("_first.asset"), "MIXED_ASSET").when(F.col("timeframe") != F.col("_first.timeframe"), "MIXED_TIMEFRAME").when(F.col("open_time") <= F.col("_before"), "NOT_INCREASING")
    return rows.withColumn("violation", broken).where("violation is not null").select(*candles.columns, "violation")


class Replay:
    """The clock of one replay; candles stay in their DataFrame, only their number and bounds are read."""

    def __init__(self, candles: DataFrame) -> None:
        numbered = candles.withColumn("ordinal", F.row_number().over(Window.partitionBy("session_id").orderBy("open_time")))
        facts = numbered.agg(F.count("*"), F.min("open_time"), F.count_distinct("asset", "timeframe"), F.min("asset"), F.min("timeframe"), F.count_distinct("open_time")).first()
        if not facts[0]:
            raise ValueError("a replay needs candles")
        if facts[2] != 1:
            raise ValueError("candles must share asset and timeframe")
        if facts[5] != facts[0]:
            raise ValueError("open times must be strictly increasing")
        self.candles, self.total, self._first, self.asset, self.timeframe = candles, facts[0], facts[1], facts[3], facts[4]
        self.reset()

    def reset(self) -> None:
        self.status, self.clock, self.position = IDLE, None, 0

    def start(self) -> None:
        if self.status != FINISHED:
            self.clock, self.status = self.clock or self._first, RUNNING

    def pause(self) -> None:
        self.status = PAUSED if self.status == RUNNING else self.status

    def resume(self) -> None:
        self.status = RUNNING if self.status == PAUSED else self.status

    def stop(self) -> None:
        self.status = self.status if self.status == FINISHED else STOPPED

    def advance(self, seconds: int = 60) -> DataFrame:
        """Move a running clock on and return what it has released."""
        if seconds <= 0:
            raise ValueError("seconds must be positive")
        if self.status != RUNNING:
            return self.candles.limit(0)
        before, self.clock = self.clock, self.clock + timedelta(seconds=seconds)
        self.position = self.visible().count()
        if self.position == self.total:
            self.status = FINISHED
        return self.visible().where(F.col("close_time") > F.lit(before))

    def visible(self) -> DataFrame:
        return visible(self.candles, self.clock) if self.clock else self.candles.limit(0)

    def state(self) -> dict:
        """Status and visible candles, with prices as text; for an interface."""
        rows = self.visible().orderBy("open_time").select("open_time", "close_time", *[F.col(c).cast("decimal(38,18)").alias(c) for c in ("open", "high", "low", "close")]).collect()
        candles = [{"open_time": r[0], "close_time": r[1]} | {c: plain(r[c]) for c in ("open", "high", "low", "close")} for r in rows]
        return {"status": self.status, "asset": self.asset, "timeframe": self.timeframe, "position": self.position, "total": self.total, "current_time": self.clock, "candles": candles}

    def request_advance(self, seconds: int = 60) -> dict:
        """Advance within an interface's bounds and return the state."""
        if not 0 < seconds <= MAX_ADVANCE_SECONDS:
            raise ValueError(f"seconds must be between 1 and {MAX_ADVANCE_SECONDS}")
        self.advance(seconds)
        return self.state()

    @staticmethod
    def health() -> dict[str, str]:
        return {"status": "ok"}


def chart_series(candles: DataFrame) -> DataFrame:
    """Epoch seconds and double prices, for a chart."""
    return candles.select(F.unix_seconds(F.col("open_time").cast("timestamp")).alias("time"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")])



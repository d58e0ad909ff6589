"""Market features over candles in order of open_time.

Windows count candles, never clock time, and are computed per ``by`` (a session,
or a session and an as-of instant), in buckets of time into which the candles
that a window reaches back to are copied (:mod:`wickline.operators.halo`); small
groups need no buckets.  Undefined is null, never False or 0.
``structural`` features run over closed candles only; ``pairwise`` ones over all
rows, null where a side is still open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from wickline.operators import halo

RISING, FALLING, MIXED = "RISING_STRUCTURE", "FALLING_STRUCTURE", "MIXED_STRUCTURE"


def direction() -> Column:
    o, c = F.col("open"), F.col("close")
    return F.when(c > o, "CLOSE_ABOVE_OPEN").when(c < o, "CLOSE_BELOW_OPEN").otherwise("CLOSE_EQUAL_OPEN")


def amplitude() -> Column:
    return F.col("high") - F.col("low")


def ordered(by: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy("open_time")


def simple_return(w: WindowSpec) -> Column:
    """Change of the close against the previous candle's; null if that one is open or closed at 0."""
    before = F.lag("close").over(w)
    return F.when(F.lag("is_closed").over(w), (F.col("close") - before) / F.nullif(before, F.lit(0).cast("double")))


def structure(w: WindowSpec, both_closed: bool = False) -> dict[str, Column]:
    """higher_high, higher_low, lower_high and lower_low against the previous candle."""
    high, low = F.lag("high").over(w), F.lag("low").over(w)
    out = {"higher_high": F.col("high") > high, "higher_low": F.col("low") > low, "lower_high": F.col("high") < high, "lower_low": F.col("low") < low}
    if both_closed:
        closed = F.col("is_closed") & F.lag("is_closed").over(w)
        out = {name: F.when(closed, c) for name, c in out.items()}
    return out


def pairwise(candles: DataFrame, by: list[str], bucket: str | None = "day") -> DataFrame:
    """All pairwise features of every candle."""
    def add(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumns({"direction": direction(), "amplitude": amplitude(), "return": simple_return(w)} | structure(w, both_closed=True))

    return halo.over(candles, by, "open_time", add, before=1, bucket=bucket)


def closed_only(candles: DataFrame) -> DataFrame:
    return candles.where("is_closed")


def _window(least: int, name: str, value: int) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{name} must be a whole number of {least} or more")


def _volatility(df: DataFrame, w: WindowSpec, window: int) -> DataFrame:
    before, step = F.lag("close").over(w), halo.fresh("_change", df)
    change = (F.col("close") - before) / F.nullif(before, F.lit(0).cast("double"))
    inside = w.rowsBetween(-(window - 2), 0)
    full = (F.row_number().over(w) >= window) & (F.count(step).over(inside) == window - 1)
    return df.withColumn(step, change).withColumn("volatility", F.when(full, F.stddev_pop(step).over(inside))).drop(step)


def _trend(df: DataFrame, w: WindowSpec, pairs: int, name: str = "trend") -> DataFrame:
    s, rises, falls = structure(w), halo.fresh("_up", df), halo.fresh("_down", df)
    inside = w.rowsBetween(-(pairs - 1), 0)
    up, down = F.min(rises).over(inside) == 1, F.min(falls).over(inside) == 1
    found = F.when(F.row_number().over(w) > pairs, F.when(up, RISING).when(down, FALLING).otherwise(MIXED))
    marked = df.withColumns({rises: (s["higher_high"] & s["higher_low"]).cast("int"), falls: (s["lower_high"] & s["lower_low"]).cast("int")})
    return marked.withColumn(name, found).drop(rises, falls)


def _lateral(df: DataFrame, w: WindowSpec, window: int, max_range: float) -> DataFrame:
    inside, name = w.rowsBetween(-(window - 1), 0), halo.fresh("_structure", df)
    first = F.first("close").over(inside)
    ratio = (F.max("high").over(inside) - F.min("low").over(inside)) / F.nullif(F.abs(first), F.lit(0).cast("double"))
    # a first close of 0 leaves the ratio null, and the feature undefined whatever the structure
    found = F.when((F.row_number().over(w) >= window) & (first != 0), (F.col(name) == MIXED) & (ratio <= float(max_range)))
    return _trend(df, w, window - 1, name).withColumn("lateral", found).drop(name)


def _quality(df: DataFrame, w: WindowSpec, needed: int) -> DataFrame:
    inside = w.rowsBetween(-(needed - 1), 0)
    full = (F.count("*").over(inside) == needed) & (F.count("confidence").over(inside) == needed)
    broken = F.max(~F.coalesce(F.col("confidence").between(0, 1), F.lit(True)) | F.isnan(F.col("confidence").cast("double"))).over(inside)
    refused = F.raise_error(F.lit("confidence must be from 0 to 1")).cast("double")
    return df.withColumn("quality", F.when((F.count("*").over(inside) == needed) & broken, refused).when(full, F.min("confidence").over(inside)))


def structural(closed: DataFrame, by: list[str], *, volatility: int | None = None, trend: int | None = None, lateral: tuple[int, float] | None = None, quality: int | None = None, count: bool = False, bucket: str | None = "day") -> DataFrame:
    """Several structural features of closed candles, whose windows share one dealing of the candles.

    ``count`` adds ``closed``, the candles up to each one, as far as the longest window looks back.
    """
    reach = [0]
    if volatility is not None:
        _window(3, "window", volatility)
        reach.append(volatility - 1)
    if trend is not None:
        _window(1, "pairs", trend)
        reach.append(trend)
    if lateral is not None:
        _window(3, "window", lateral[0])
        if lateral[1] < 0:
            raise ValueError("max_range must not be negative")
        reach.append(lateral[0] - 1)
    if quality is not None:
        reach.append(quality - 1)

    def add(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = df if volatility is None else _volatility(df, w, volatility)
        df = df if trend is None else _trend(df, w, trend)
        df = df if lateral is None else _lateral(df, w, *lateral)
        df = df if quality is None else _quality(df, w, quality)
        return df.withColumn("closed", F.least(F.row_number().over(w), F.lit(max(reach) + 1))) if count else df

    return halo.over(closed, by, "open_time", add, before=max(reach), bucket=bucket)


def volatility(closed: DataFrame, by: list[str], window: int, bucket: str | None = "day") -> DataFrame:
    """``volatility``: population deviation of the returns within the last ``window`` closed candles."""
    return structural(closed, by, volatility=window, bucket=bucket)


def trend(closed: DataFrame, by: list[str], pairs: int, bucket: str | None = "day") -> DataFrame:
    """``trend``: structure of the last ``pairs`` pairs of closed candles."""
    return structural(closed, by, trend=pairs, bucket=bucket)


def lateral(closed: DataFrame, by: list[str], window: int, max_range: float, bucket: str | None = "day") -> DataFrame:
    """``lateral``: no structure within the window, and its range is at most ``max_range`` of its first close."""
    return structural(closed, by, lateral=(window, max_range), bucket=bucket)


def quality(closed: DataFrame, by: list[str], needed: int, bucket: str | None = "day") -> DataFrame:
    """``quality``: least confidence of the last ``needed`` closed candles; null if any is missing.

    A confidence beyond [0, 1] among them fails the job, also beside a missing one.
    """
    return structural(closed, by, quality=needed, bucket=bucket)

"""From chart images to canonical candles: observe, read the scale, map to prices, track and normalise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickline.config import timeframe_seconds
from wickline.operators import asof, candles, price_labels, price_scale, tracking, vision
from wickline.scratch import written


@dataclass(frozen=True)
class Reconstruction:
    """``frames``: status and reason of each frame; ``candles``: canonical ones as they are after all frames."""

    frames: DataFrame
    candles: DataFrame


def scale_regions(images: DataFrame, charts: DataFrame) -> DataFrame:
    """(image, content, x, y, width, height): the box of each chart's price scale."""
    box = charts.where("status = 'OK' and price_scale_x is not null")
    left = F.col("price_scale_x") + 1
    box = box.select("image", (F.col("x") + left).alias("x"), "y", F.greatest(F.lit(1), F.col("chart_width") - left).alias("width"), F.col("chart_height").alias("height"))
    return images.select(F.col("image").cast("string").alias("image"), "content").join(box, "image")


def anchors_of(read: DataFrame) -> DataFrame:
    """(image, y, price, confidence) of the labels of every chart's scale."""
    return read.select("image", F.explode("labels").alias("l")).select("image", "l.y", "l.price", "l.confidence")


def priced(read: DataFrame) -> DataFrame:
    """Candles of every chart in prices, by its labels."""
    anchors = anchors_of(read)
    return price_scale.map_candles(vision.visual_candles(read), anchors, ["image"], price_scale.calibrate(anchors, ["image"]))


def priced_candles(images: DataFrame, font: dict[str, str] = price_labels.FONT) -> tuple[DataFrame, DataFrame]:
    """(status of each image with its calibration, its candles in prices).

    A chart without a scale, a scale without two readable labels or one that
    contradicts itself, and a candle beyond it, are PRICE_SCALE_NOT_FOUND with the
    reason.  Every picture is decoded once, and what was read of it is written.
    """
    read = images if "bars" in images.columns else written(vision.read(images, font), "pictures")
    observed = vision.observe(read).select("image", "status", "visual_quality")
    anchors = anchors_of(read)
    scale = price_scale.calibrate(anchors, ["image"])
    mapped = price_scale.map_candles(vision.visual_candles(read), anchors, ["image"], scale.where("reason is null"))
    beyond = mapped.groupBy("image").agg(F.bool_or(F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()).alias("beyond"))
    state = observed.join(read.select("image", "price_scale_x"), "image")
    state = state.join(scale.select("image", F.col("reason").alias("scale_reason"), F.col("anchors"), F.col("confidence").alias("calibration_confidence")), "image", "left").join(beyond, "image", "left")
    why = (
        F.when(F.col("status") != "OK", F.col("status")).when(F.col("price_scale_x").isNull(), "PRICE_SCALE_NOT_FOUND").when(F.coalesce("anchors", F.lit(0)) < 2, "INSUFFICIENT_VISUAL_PRICE_ANCHORS")
        .when(F.col("scale_reason").isNotNull(), F.col("scale_reason")).when(F.col("beyond"), "Y_OUTSIDE_CALIBRATED_RANGE")
    )
    state = state.withColumn("reason", why)
    state = state.withColumn("status", F.when((F.col("status") == "OK") & F.col("reason").isNotNull(), "PRICE_SCALE_NOT_FOUND").otherwise(F.col("status")))
    quality = observed.select("image", "visual_quality")
    fine = mapped.join(state.where("status = 'OK'").select("image"), "image", "left_semi").join(quality, "image")
    fine = fine.withColumn("confidence", F.least("confidence", "visual_quality")).drop("visual_quality")
    return state.select("image", "status", "reason", "calibration_confidence"), fine


#: One row a frame, as :func:`observed` gives them: what its picture shows, before any tracking.
OBSERVED = (
    "session_id string, frame_id string, captured_at timestamp, status string, reason string, calibration_confidence double, "
    "bars array<struct<x:int,open:double,high:double,low:double,close:double,confidence:double>>"
)


def observed(frames: DataFrame, font: dict[str, str] = price_labels.FONT) -> DataFrame:
    """OBSERVED of frames (session_id, frame_id, captured_at, content); bars are in order of x, and there are none in failed frames."""
    kept = written(frames.select("session_id", "frame_id", F.col("captured_at").cast("timestamp").alias("captured_at"), "content"), "frames")
    state, seen = (written(df, "priced") for df in priced_candles(kept.select(F.col("frame_id").alias("image"), "content"), font))
    bars = seen.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("x", "open", "high", "low", "close", "confidence"))).alias("bars"))
    told = state.join(bars, "image", "left").withColumnRenamed("image", "frame_id")
    out = kept.select("session_id", "frame_id", "captured_at").join(told, "frame_id", "left")
    return out.select("session_id", "frame_id", "captured_at", F.coalesce("status", F.lit("CHART_NOT_FOUND")).alias("status"), "reason", "calibration_confidence", "bars")


def canonical(results: DataFrame, source_id: str, asset: str, timeframe: str) -> DataFrame:
    """Canonical candles as they are after all ``results``, which :func:`wickline.streaming.streams.reconstruct` gave."""
    rows = results.select("session_id", F.col("frame_id").alias("arrival"), F.explode("candles").alias("c")).select("session_id", "arrival", "c.*")
    rows = rows.withColumns({"open_time": F.timestamp_seconds("open_s"), "close_time": F.timestamp_seconds(F.col("open_s") + timeframe_seconds(timeframe))})
    return candles.normalize(rows.withColumnRenamed("last_seen", "last_seen_at").drop("open_s"), source_id, asset, timeframe)


def last_good(frames: DataFrame) -> DataFrame:
    """Frames with the calibration confidence that a session reports: its own if the scale could be read, else that of
    the last frame before that was reconstructed, and 0 before the first."""
    own = F.col("status").isin("OK", "TRACKING_LOST")
    good = frames.withColumn("_good", F.when(F.col("status") == "OK", F.col("calibration_confidence")))
    before = asof.carried(good, ["session_id"], "captured_at", ["frame_id"], "_good", "_last")
    return before.withColumn("calibration_confidence", F.when(own, F.col("calibration_confidence")).otherwise(F.coalesce("_last", F.lit(0.0)))).drop("_good", "_last")


def reconstruct(images: DataFrame, frames: DataFrame, timeframe: str, source_id: str, asset: str, font: dict[str, str] = price_labels.FONT, **tolerances) -> Reconstruction:
    """Candles of frames (frame_id, session_id, captured_at) whose pictures are ``images`` (image = frame_id, content).

    Frames that cannot be read, or that the tracker loses, add nothing and keep
    their status and reason; they report the session's last good calibration
    (:func:`last_good`).  No truth is looked at.
    """
    state, seen = (written(df, "priced") for df in priced_candles(images, font))
    seen = seen.withColumnRenamed("image", "frame_id").join(frames.select("frame_id", "session_id", F.col("captured_at").cast("timestamp").alias("captured_at")), "frame_id")
    tracked = written(tracking.track(seen.select("session_id", "frame_id", "captured_at", "x", "confidence"), timeframe, **tolerances), "tracked")
    statuses = frames.select("frame_id", "session_id", "captured_at").join(state.withColumnRenamed("image", "frame_id"), "frame_id", "left")
    told = tracked.select("frame_id", F.col("status").alias("t_status"), F.col("reason").alias("t_reason"), "shift_px", "new_ids", "updated_ids", "closed_ids")
    out = statuses.join(told, "frame_id", "left")
    out = out.select("frame_id", "session_id", "captured_at", F.coalesce("t_status", "status", F.lit("CHART_NOT_FOUND")).alias("status"), F.coalesce("t_reason", "reason").alias("reason"), "calibration_confidence", "shift_px", "new_ids", "updated_ids", "closed_ids")
    each = tracked.where("status = 'OK'").select("session_id", "frame_id", F.explode("candles").alias("c")).select("session_id", "frame_id", "c.*")
    rows = each.join(seen.select("frame_id", "x", "open", "high", "low", "close"), ["frame_id", "x"])
    opened = F.timestamp_seconds("open_s")
    rows = rows.select(
        "session_id", opened.alias("open_time"), F.timestamp_seconds(F.col("open_s") + timeframe_seconds(timeframe)).alias("close_time"), F.col("last_seen").alias("last_seen_at"), F.col("frame_id").alias("arrival"),
        "open", "high", "low", "close", "is_closed", "confidence",
    )
    return Reconstruction(last_good(out), candles.normalize(rows, source_id, asset, timeframe))

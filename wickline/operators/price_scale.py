"""Pixel to price: calibration of scale anchors and interpolation between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_DEVIATION = 0.05


def calibrate(anchors: DataFrame, by: list[str], max_deviation: float = MAX_DEVIATION) -> DataFrame:
    """Per scale (``by``) of anchors (y, price, confidence): orientation, range, confidence, or the ``reason`` of failure."""
    w = Window.partitionBy(*by).orderBy("y", "price")
    gap = F.lead("price").over(w) - F.col("price")
    run = F.lead("y").over(w) - F.col("y")
    steps = anchors.withColumns({"_gap": gap, "_run": run}).withColumn("_slope", F.abs(F.col("_gap") / F.nullif(F.col("_run").cast("double"), F.lit(0.0))))
    mean = steps.withColumn("_mean", F.avg("_slope").over(Window.partitionBy(*by)))
    found = mean.groupBy(*by).agg(
        F.count("*").alias("anchors"), F.count_distinct("y").alias("_places"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.min("confidence").alias("_least"),
        F.bool_and(F.when(F.col("_gap").isNotNull(), F.col("_gap") < 0)).alias("_falls"), F.bool_and(F.when(F.col("_gap").isNotNull(), F.col("_gap") > 0)).alias("_rises"),
        F.max(F.abs(F.col("_slope") - F.col("_mean")) / F.nullif("_mean", F.lit(0.0))).alias("deviation"),
    )
    reason = (
        F.when(F.col("anchors") < 2, "INSUFFICIENT_PRICE_ANCHORS").when(F.col("_places") < F.col("anchors"), "DUPLICATE_PRICE_ANCHOR_Y")
        .when(~F.col("_falls") & ~F.col("_rises"), "NON_MONOTONIC_PRICE_ANCHORS").when(F.col("deviation") > max_deviation, "INCONSISTENT_PRICE_ANCHORS")
    )
    ok = F.col("reason").isNull()
    return found.withColumn("reason", reason).select(
        *by, "anchors", "min_y", "max_y", F.when(ok, F.when(F.col("_falls"), "PRICE_INCREASES_UP").otherwise("PRICE_INCREASES_DOWN")).alias("orientation"),
        F.when(ok, F.col("_least") * F.greatest(F.lit(0.0), 1 - F.col("deviation"))).alias("confidence"), "reason",
    )


def prices_at(points: DataFrame, anchors: DataFrame, by: list[str]) -> DataFrame:
    """``points`` (by, y) with ``price``: the anchor's own, or interpolated; null and a reason outside the scale."""
    w = Window.partitionBy(*by).orderBy("y")
    spans = anchors.select(*by, F.col("y").alias("y0"), F.col("price").alias("p0"), F.lead("y").over(w).alias("y1"), F.lead("price").over(w).alias("p1"))
    inside = (F.col("y") == F.col("y0")) | ((F.col("y0") < F.col("y")) & (F.col("y") < F.col("y1")))
    keys = [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
    joined = points.alias("p").join(spans.alias("s"), [*keys, inside], "left")
    price = F.when(F.col("y") == F.col("y0"), F.col("p0")).otherwise(F.col("p0") + (F.col("p1") - F.col("p0")) * (F.col("y") - F.col("y0")) / (F.col("y1") - F.col("y0")))
    out = joined.select(*[F.col(f"p.{c}") for c in points.columns], price.alias("price"))
    return out.withColumn("reason", F.when(F.col("price").isNull(), "Y_OUTSIDE_CALIBRATED_RANGE"))


def map_candles(visual: DataFrame, anchors: DataFrame, by: list[str], scale_confidence: DataFrame) -> DataFrame:
    """Candles in pixels (by, x, direction, body_top, body_bottom, upper_top, lower_bottom, confidence) to prices.

    Bottoms are the last pixel row of a part; wicks are null where there is none.
    """
    up = F.col("direction") == "UP"
    places = {
        "open": F.when(up, F.col("body_bottom")).otherwise(F.col("body_top")), "high": F.coalesce("upper_top", "body_top"),
        "low": F.coalesce("lower_bottom", "body_bottom"), "close": F.when(up, F.col("body_top")).otherwise(F.col("body_bottom")),
    }
    points = visual.select(*visual.columns, F.explode(F.create_map(*[x for name, y in places.items() for x in (F.lit(name), y)])).alias("field", "y"))
    priced = prices_at(points, anchors, by)
    fields = [F.max(F.when(F.col("field") == name, F.col("price"))).alias(name) for name in places]
    out = priced.groupBy(*by, "x", "direction", "confidence").agg(*fields)
    scale = scale_confidence.select(*by, F.col("confidence").alias("_scale"))
    return out.join(scale, by).withColumn("confidence", F.least("confidence", "_scale")).drop("_scale")

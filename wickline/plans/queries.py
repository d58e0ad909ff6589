"""The registered queries of the candle engine, on series made of the events table."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wickline import schema
from wickline.config import AnalysisConfig
from wickline.operators import asof, candles, capture, classify, features, outcome, pipeline, price_labels, price_scale, reconstruction, replay, store, vision
from wickline.scratch import written
from wickline.sources import readers

SESSION = ["session_id"]
CONFIG = AnalysisConfig(2, 4, Decimal("0.9"), 0.5)
AS_OF, HORIZON, THRESHOLD = "2024-01-15 12:00:00", 3, 0.05


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return readers.event_ticks(spark, sf)


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return candles.snapshots(ticks(spark, sf))


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """The snapshots as a store holds them: written once, for queries that look at them several times."""
    return written(snapshots(spark, sf), "snapshots")


def closed(known: DataFrame) -> DataFrame:
    """Closed candles with the time they were known closed."""
    return known.where("is_closed").withColumn("close_time", F.col("open_time") + F.expr("INTERVAL 1 HOUR"))


def closing(spark: SparkSession, sf: str) -> DataFrame:
    """The closed candles alone, written once."""
    return closed(written(candles.closings(ticks(spark, sf)), "closed"))


def midnights(spark: SparkSession, sf: str) -> DataFrame:
    days = ticks(spark, sf).select("session_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("as_of"))
    return days.distinct()


def _nine(*names: str) -> dict:
    return {n: F.round(n, 9) for n in names}


def candles_from_ticks(spark, sf):
    return candles.candles(ticks(spark, sf)).select("session_id", "open_time", "open", "high", "low", "close", "ticks")


def snapshots_cumulative(spark, sf):
    return snapshots(spark, sf).select("session_id", "open_time", "ts", "seq", "open", "high", "low", "close", "is_closed", "confidence")


def candles_for_frame(spark, sf):
    """Candles as reconstructed for each frame; there is a frame a minute with ticks."""
    name = F.lpad(F.col("seq").cast("string"), 12, "0")
    s = snapshots(spark, sf).withColumn("observation_id", name)
    o = ticks(spark, sf).select(name.alias("observation_id"), F.concat(F.lit("f"), F.date_format("ts", "yyyyMMddHHmm")).alias("frame_id"))
    return asof.candles_of_frames(s, o).select("frame_id", "session_id", "open_time", "ts", "open", "high", "low", "close", "is_closed")


def candles_as_of(spark, sf):
    return asof.as_of(snapshots(spark, sf), _ts(AS_OF)).select("session_id", "open_time", "ts", "open", "high", "low", "close", "is_closed")


def candles_as_of_batched(spark, sf):
    """What every session knew at every midnight, counted and summed up."""
    known = asof.as_of_many(stored(spark, sf), midnights(spark, sf))
    return known.groupBy("session_id", "as_of").agg(F.count("*").alias("known"), F.count_if("is_closed").alias("closed"), F.max("open_time").alias("newest"), F.round(F.sum("close"), 4).alias("sum_close"))


def canonical_latest(spark, sf):
    return store.canonical(snapshots(spark, sf)).select("session_id", "open_time", "ts", "open", "high", "low", "close", "is_closed")


def latest_snapshot_ts(spark, sf):
    return store.latest_knowledge(snapshots(spark, sf))


def _altered(spark, sf):
    """Snapshots of which some break the rules of evolution."""
    s = snapshots(spark, sf)
    return s.withColumns({"high": F.when(F.col("seq") % 41 == 0, F.col("high") - 50).otherwise(F.col("high")), "open": F.when(F.col("seq") % 53 == 0, F.col("open") + 1).otherwise(F.col("open"))})


def evolution_violations(spark, sf):
    return store.evolution_violations(_altered(spark, sf)).select("session_id", "open_time", "ts", "seq", "violation")


def same_ts_conflicts(spark, sf):
    """Snapshots cut to the minute, so that several states meet at one time."""
    s = snapshots(spark, sf).withColumn("ts", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    return store.same_time_conflicts(s, ["open", "high", "low", "close", "is_closed"])


def constraint_violations(spark, sf):
    """Altered snapshots against the rules of prices, confidence and ids."""
    s = _altered(spark, sf).withColumns({"confidence": F.when(F.col("seq") % 61 == 0, F.lit(1.5)).otherwise(F.col("confidence"))})
    return schema.violations(s, schema.ohlc_rules() | {"confidence_range": schema.within_unit("confidence"), "session_id_empty": schema.filled("session_id")}).select("session_id", "ts", "seq", "is_closed", "violation")


def key_duplicates(spark, sf):
    return schema.duplicate_keys(ticks(spark, sf), ["session_id", "open_time", "user_id"])


def orphan_audit(spark, sf):
    """Candles without a session, if one session is missing."""
    sessions = ticks(spark, sf).select("session_id").distinct().where("session_id <> 'error'")
    return schema.orphans(candles_from_ticks(spark, sf), sessions, ["session_id"]).select("session_id", "open_time")


def idempotent_merge_plan(spark, sf):
    """A batch of candles of which some are stored alike, and some otherwise."""
    c = candles_from_ticks(spark, sf).drop("ticks")
    stored = c.where("hour(open_time) < 16").withColumn("close", F.when(F.hour("open_time") % 5 == 0, F.col("close") + 1).otherwise(F.col("close")))
    return store.merge_plan(c, stored, ["session_id", "open_time"]).select("session_id", "open_time", "action")


def replay_visible(spark, sf):
    return replay.visible(closing(spark, sf), _ts(AS_OF)).select("session_id", "open_time", "open", "high", "low", "close")


def replay_release_steps(spark, sf):
    return replay.release_steps(closing(spark, sf), midnights(spark, sf).withColumnRenamed("as_of", "clock")).select("session_id", "clock", "position", "released")


def sequence_validation(spark, sf):
    """Candles in an order that is broken at some places."""
    w = Window.partitionBy("session_id").orderBy("open_time")
    c = candles_from_ticks(spark, sf).withColumns({"ordinal": F.row_number().over(w), "asset": F.when(F.hour("open_time") == 13, "OTHER").otherwise(F.col("session_id")), "timeframe": F.lit("1h")})
    c = c.withColumn("open_time", F.when(F.col("ordinal") % 50 == 0, F.col("open_time") - F.expr("INTERVAL 5 DAYS")).otherwise(F.col("open_time")))
    return replay.sequence_violations(c).select("session_id", "ordinal", "violation")


def direction(spark, sf):
    return candles_from_ticks(spark, sf).select("session_id", "open_time", features.direction().alias("direction"))


def amplitude(spark, sf):
    return candles_from_ticks(spark, sf).select("session_id", "open_time", F.round(features.amplitude(), 9).alias("amplitude"))


def _pairwise(spark, sf):
    return features.pairwise(asof.as_of(snapshots(spark, sf), _ts(AS_OF)), SESSION)


def returns(spark, sf):
    return _pairwise(spark, sf).select("session_id", "open_time", F.round("return", 9).alias("return"))


def hh_hl_lh_ll(spark, sf):
    return _pairwise(spark, sf).select("session_id", "open_time", "higher_high", "higher_low", "lower_high", "lower_low")


def volatility(spark, sf):
    return features.volatility(closing(spark, sf), SESSION, 5).select("session_id", "open_time", F.round("volatility", 9).alias("volatility"))


def basic_trend(spark, sf):
    return features.trend(closing(spark, sf), SESSION, 2).select("session_id", "open_time", "trend")


def basic_lateralization(spark, sf):
    return features.lateral(closing(spark, sf), SESSION, 4, 0.9).select("session_id", "open_time", "lateral")


def data_quality(spark, sf):
    return features.quality(closing(spark, sf), SESSION, 4).select("session_id", "open_time", "quality")


def last_closed(spark, sf):
    return asof.last_n(closing(spark, sf), 3, SESSION).select("session_id", "open_time", "close")


def analysis_decision(spark, sf):
    return classify.analyze(stored(spark, sf), midnights(spark, sf), CONFIG).select("session_id", "as_of", "state_rule", "market_state", "confidence", "quality")


def analysis_evidence(spark, sf):
    return classify.analyze(stored(spark, sf), midnights(spark, sf), CONFIG, persisted=True).select("session_id", "as_of", F.array_join("evidence", "|").alias("evidence"))


def _dense(known: DataFrame) -> DataFrame:
    requests = known.where("is_closed").select("session_id", F.col("ts").alias("as_of"))
    return classify.analyze_in_order(known, requests, CONFIG)


def analysis_dense(spark, sf):
    """A decision at every closing, by the linear path."""
    return _dense(closing(spark, sf)).select("session_id", "as_of", "state_rule", "market_state", "confidence")


def _truth(spark, sf):
    return candles_from_ticks(spark, sf).withColumns({"asset": F.col("session_id"), "timeframe": F.lit("1h")})


def _reconstructed(spark, sf):
    """Candles as a reader of charts sees them: flat ones have no body to see, and some are seen twice."""
    seen = candles.candles(ticks(spark, sf)).where("open <> close").withColumns({"asset": F.col("session_id"), "timeframe": F.lit("1h")})
    times = F.when(F.hour("open_time") % 7 == 0, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    again = seen.withColumn("arrival", F.explode(times))
    return again.withColumn("close", F.when(F.col("arrival") == 2, F.col("low")).otherwise(F.col("close")))


def reconstruction_match(spark, sf):
    return reconstruction.matched(_reconstructed(spark, sf), _truth(spark, sf)).select("session_id", "open_time", "detected", "close", "r_open", "r_high", "r_low", "r_close")


def reconstruction_metrics(spark, sf):
    return reconstruction.metrics(_reconstructed(spark, sf), _truth(spark, sf)).withColumns(_nine("open_mean_error", "high_mean_error", "low_mean_error", "close_mean_error", "detection_rate", "direction_accuracy", "duplicate_rate", "missing_rate"))


def normalize_dedup(spark, sf):
    """The last seen snapshot of each candle, by minutes, of ties the later arrival."""
    s = snapshots(spark, sf).withColumns({"last_seen_at": F.date_trunc("minute", "ts").cast("timestamp_ntz"), "arrival": F.col("seq")})
    return candles.keep_latest(s.where("not is_closed")).select("session_id", "open_time", "arrival", "close")


def ohlc_reject_reasons(spark, sf):
    s = _altered(spark, sf).withColumn("low", F.when(F.col("seq") % 37 == 0, F.col("low") + 80).otherwise(F.col("low")))
    return s.withColumn("reason", candles.reject_reason()).where("reason is not null").select("session_id", "seq", "is_closed", "reason")


def bands(spark, sf):
    """Runs of consecutive hours with candles."""
    c = candles_from_ticks(spark, sf).withColumn("hour", F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', open_time)"))
    return candles.bands(c, SESSION, "hour")


def frame_change_flags(spark, sf):
    """A frame a tick, whose picture is its price's tens."""
    f = ticks(spark, sf).select("session_id", F.col("seq").alias("frame_id"), F.col("ts").alias("captured_at"), F.sha2(F.floor(F.col("price") / 10).cast("string"), 256).alias("image_hash"))
    return capture.change_flags(f).select("session_id", "frame_id", "image_hash", "changed")


def _anchors(spark, sf):
    """A price scale for each session and day: an anchor for each candle at y = 100, 200, ...; some are broken."""
    c = candles_from_ticks(spark, sf).withColumn("day", F.date_trunc("day", "open_time").cast("timestamp_ntz"))
    w = Window.partitionBy("session_id", "day").orderBy("open_time")
    c = c.withColumn("k", F.row_number().over(w))
    bend = F.when((F.dayofmonth("day") % 4 == 0) & (F.col("k") == 3), 7.5).otherwise(0.0)
    return c.select("session_id", "day", (F.col("k") * 100).alias("y"), (F.lit(500.0) - F.col("k") * 10.0 - bend).alias("price"), (F.lit(0.9) + F.col("k") * 0.01).alias("confidence"))


def anchor_calibration(spark, sf):
    return price_scale.calibrate(_anchors(spark, sf), ["session_id", "day"]).withColumns(_nine("confidence"))


def price_interpolation(spark, sf):
    points = ticks(spark, sf).select("session_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "seq", (F.col("seq") % 2450 + 50).alias("y"))
    return price_scale.prices_at(points, _anchors(spark, sf), ["session_id", "day"]).select("session_id", "seq", "y", F.round("price", 9).alias("price"), "reason")


def spacing_shift_median(spark, sf):
    """Median distance of neighbours and its half-even whole, by session and day."""
    t = ticks(spark, sf).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    gap = F.col("seq") - F.lag("seq").over(Window.partitionBy("session_id", "day").orderBy("seq"))
    g = t.withColumn("gap", gap).where("gap is not null").groupBy("session_id", "day").agg(F.median("gap").alias("spacing"))
    return g.withColumn("shift", F.bround("spacing", 0).cast("int"))


def _sessions(spark, sf):
    first = ticks(spark, sf).groupBy("session_id").agg(F.min("ts").alias("origin_time"))
    return first.withColumn("tracking_state", F.when(F.col("session_id") == "signup", "LEGACY_UNKNOWN").otherwise("TRACKED"))


def exposure_frontier(spark, sf):
    exposures = ticks(spark, sf).select("session_id", F.col("ts").alias("exposed_at"))
    return outcome.exposure_frontier(_sessions(spark, sf), exposures).select("session_id", "tracking_state", "exposure_frontier")


def _policies(spark, sf):
    late = F.when(F.col("session_id") == "view", F.col("origin_time") + F.expr("INTERVAL 10 DAYS")).otherwise(F.col("origin_time"))
    return _sessions(spark, sf).where("session_id <> 'click'").select(F.concat(F.lit("p-"), "session_id").alias("policy_id"), "session_id", F.lit(HORIZON).alias("horizon"), F.lit(THRESHOLD).alias("threshold"), late.alias("bound_at"))


def policy_registration(spark, sf):
    requests = _sessions(spark, sf).select(F.concat(F.lit("p-"), "session_id").alias("policy_id"), "session_id", F.when(F.col("session_id") == "error", 5).otherwise(HORIZON).alias("horizon"), F.lit(THRESHOLD).alias("threshold"))
    frontier = _sessions(spark, sf).withColumn("exposure_frontier", F.col("origin_time"))
    return outcome.register_policies(requests, frontier, _policies(spark, sf)).select("policy_id", "session_id", "horizon", "action", "bound_at")


def policy_eligibility(spark, sf):
    a = midnights(spark, sf)
    return a.join(_policies(spark, sf), "session_id").where("bound_at <= as_of").select("session_id", "as_of", "policy_id")


def outcome_reference(spark, sf):
    return asof.last_known(midnights(spark, sf), closing(spark, sf), SESSION, "as_of", "close_time", ["open_time", "close"], tie=["open_time"])


def outcome_horizon(spark, sf):
    return outcome.with_horizon(closing(spark, sf), HORIZON).select("session_id", "reference_open_time", "final_open_time", "final_close")


def _evaluated(spark, sf):
    known = closing(spark, sf)
    a = _dense(known).select(F.concat_ws("/", "session_id", F.date_format("as_of", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("analysis_id"), "session_id", F.col("as_of").alias("timestamp"), "market_state", "confidence")
    return outcome.evaluate(a, known, _policies(spark, sf), _sessions(spark, sf), HORIZON, _ts("2024-02-15 00:00:00"), exhausted=F.col("session_id") == "purchase")


def availability_status(spark, sf):
    return _evaluated(spark, sf).groupBy("session_id", "status").agg(F.count("*").alias("analyses"))


def outcome_state(spark, sf):
    return _evaluated(spark, sf).where("status = 'AVAILABLE'").select("session_id", "timestamp", "reference_open_time", "final_open_time", F.round("realized_return", 9).alias("realized_return"), "realized_state")


def outcome_evidence(spark, sf):
    """All tokens, with six decimals of prices and returns, joined."""
    numbers = {c: F.col(c).cast("decimal(18,6)") for c in ("reference_close", "final_close", "realized_return", "threshold")}
    e = _evaluated(spark, sf).where("status = 'AVAILABLE'").withColumns(numbers).withColumn("evidence", outcome.evidence())
    return e.select("session_id", "timestamp", F.array_join("evidence", "|").alias("evidence"))


def _pairs(spark, sf):
    return _evaluated(spark, sf).where("status = 'AVAILABLE'")


def confusion_matrix(spark, sf):
    return outcome.confusion(_pairs(spark, sf), ["policy_id"])


def precision_recall(spark, sf):
    names = [f"{m}_{s.lower()}" for s in outcome.REALIZED for m in ("precision", "recall")]
    return outcome.scores(_pairs(spark, sf), ["policy_id"]).select("policy_id", "evaluated", *[F.round(n, 9).alias(n) for n in ("accuracy", *names)])


def coverage(spark, sf):
    return outcome.scores(_pairs(spark, sf), ["policy_id"]).select("policy_id", "uncertain_count", F.round("coverage", 9).alias("coverage"), F.round("uncertain_frequency", 9).alias("uncertain_frequency"))


def confidence_calibration(spark, sf):
    return outcome.calibration(_pairs(spark, sf), ["policy_id"]).select("policy_id", "bin", "n", *[F.round(c, 9).alias(c) for c in ("mean_confidence", "observed_accuracy", "absolute_gap")])


def calibration_gap(spark, sf):
    return outcome.weighted_gap(outcome.calibration(_pairs(spark, sf), ["policy_id"]), ["policy_id"]).withColumns(_nine("weighted_alignment_gap"))


#: The columns of a candle in pixels that are rows of its page.
ROWS = ("body_top", "body_bottom", "upper_top", "lower_bottom")
#: Prices of the scale's labels and the rows that they stand at: 0.6 pixels a unit.
LABELS = [(500 - 100 * i, 100 + 60 * i) for i in range(5)]


def _bars(spark, sf):
    """The bars of each session and day, written once: how many rows ``shift`` its page needs above the usual ones, and the row ``line`` of its time scale, so that every bar lies on the chart."""
    def y_of(price):
        return (F.lit(100) + F.floor((F.lit(500.0) - price) * 0.6)).cast("int")

    c = candles_from_ticks(spark, sf).withColumn("day", F.date_format("open_time", "yyyyMMdd"))
    c = c.withColumn("k", F.row_number().over(Window.partitionBy("session_id", "day").orderBy("open_time")))
    up = F.col("close") >= F.col("open")
    bar = F.struct((F.col("k") * 22 + 100).alias("x"), y_of(F.col("high")).alias("high"), y_of(F.col("low")).alias("low"), y_of(F.greatest("open", "close")).alias("top"), y_of(F.least("open", "close")).alias("bottom"), up.alias("up"))
    bars = c.groupBy(F.concat_ws("/", "session_id", "day").alias("image")).agg(
        F.collect_list(bar).alias("bars"), F.greatest(F.lit(0), 60 - F.min(y_of(F.col("high")))).alias("shift"), F.greatest(F.lit(440), F.max(y_of(F.col("low"))) + 1).alias("line")
    )
    return written(bars, "bars")


def _pictures(bars: DataFrame) -> DataFrame:
    """A chart image for each session and day, with its candles as bars 22 pixels apart and a labelled scale."""
    def draw(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for image, shapes, shift, line in zip(*(batch.column(n).to_pylist() for n in ("image", "bars", "shift", "line"))):
                page = np.full((shift + line + 120, 800, 3), 255, dtype=np.uint8)
                page[60 : shift + line + 40, 80:720] = vision.COLOURS["background"][0]
                page[60 : shift + line + 40, 640] = page[shift + line, 80:640] = vision.COLOURS["border"][0]
                for price, y in LABELS:
                    price_labels.write_label(page, str(price), 660, shift + y, (226, 232, 240), scale=2)
                for s in shapes:
                    colour = vision.COLOURS["UP" if s["up"] else "DOWN"][0]
                    page[shift + s["high"] : shift + s["low"] + 1, s["x"]] = page[shift + s["top"] : shift + s["bottom"] + 1, s["x"] - 6 : s["x"] + 7] = colour
                yield pa.RecordBatch.from_arrays([pa.array([image]), pa.array([vision.encode_png(page)], pa.binary())], ["image", "content"])

    return bars.mapInArrow(draw, "image string, content binary")


def chart_prices(spark, sf):
    """The same candles in prices, by the labels read from each chart's scale; null beyond the labels."""
    read = written(vision.read(_pictures(_bars(spark, sf))), "pictures")  # each drawn and decoded once
    return pipeline.priced(read).select("image", "x", "direction", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")])


def _moved(rows: DataFrame, shifts: DataFrame, **by) -> DataFrame:
    """``rows`` read from pages with their columns moved back by what ``shifts`` (image, ...) says of each page."""
    return rows.join(shifts, "image").withColumns({n: (F.col(n) - off).cast("int") for n, off in by.items()})


def chart_reading(spark, sf):
    """Candles read back from drawn charts, in pixels from the row that usual pages begin with."""
    bars = _bars(spark, sf)
    seen = _moved(vision.visual_candles(_pictures(bars)), bars.select("image", "shift"), **{y: F.col("shift") for y in ROWS})
    return seen.select("image", "x", "direction", "body_top", "body_bottom", "upper_top", "lower_bottom", "width")


def _pages(rows: DataFrame) -> DataFrame:
    """A white page for each image of rectangles (image, x, y, w, h, colour), drawn in the order of ``z``, with the page's ``height`` and ``width``."""
    shape = F.struct("z", "x", "y", "w", "h", "colour")
    shapes = rows.groupBy("image", "height", "width").agg(F.sort_array(F.collect_list(shape)).alias("shapes"))  # those of one day's candles

    def draw(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for image, height, width, some in zip(*(batch.column(n).to_pylist() for n in ("image", "height", "width", "shapes"))):
                page = np.full((height, width, 3), 255, dtype=np.uint8)
                for s in some:
                    page[s["y"] : s["y"] + s["h"], s["x"] : s["x"] + s["w"]] = vision.COLOURS[s["colour"]][0]
                yield pa.RecordBatch.from_arrays([pa.array([image]), pa.array([vision.encode_png(page)], pa.binary())], ["image", "content"])

    return shapes.mapInArrow(draw, "image string, content binary")


def chart_regions(spark, sf):
    """The largest connected region of pages on which the hours of a day are dark bars that may touch those of the hours beside.

    A page has 44 columns of bars, or as many more as a day's prices need; prices beyond 44 columns, or below 0, have the
    lowest at the page's left.  A chart's share is that of the usual page.
    """
    c = candles_from_ticks(spark, sf).withColumn("image", F.concat_ws("/", "session_id", F.date_format("open_time", "yyyyMMdd")))
    cells = c.select("image", F.hour("open_time").alias("hour"), F.floor(F.col("low") / 12).cast("int").alias("left"), F.floor(F.col("high") / 12).cast("int").alias("right"))
    cells = written(cells, "cells")
    usual = (F.min("left") >= 0) & (F.max("right") < 44)
    pages = cells.groupBy("image").agg(F.when(usual, 0).otherwise(F.min("left")).alias("first"), F.max("right").alias("last"))
    pages = pages.select("image", "first", F.lit(400).alias("height"), (F.greatest(F.lit(44), F.col("last") - F.col("first") + 1) * 16).alias("width"))
    bars = cells.join(pages, "image").select(
        "image", "height", "width", F.lit(0).alias("z"), ((F.col("left") - F.col("first")) * 16).alias("x"), (F.col("hour") * 16).alias("y"),
        ((F.col("right") - F.col("left") + 1) * 16).alias("w"), F.lit(16).alias("h"), F.lit("background").alias("colour"),
    )
    found = _moved(vision.charts(_pages(bars), page=(400, 704)), pages.select("image", "first"), x=F.col("first") * -16)
    return found.select("image", "status", "x", "y", "chart_width", "chart_height")


def touching_bars(spark, sf):
    """Candles read from charts whose bars share columns with their neighbours, but touch none.

    Every other candle is in the lower half.  That half, and the whole chart, lie as far down on a page as its prices need.
    """
    c = candles_from_ticks(spark, sf).withColumn("image", F.concat_ws("/", "session_id", F.date_format("open_time", "yyyyMMdd")))
    c = c.withColumn("k", F.row_number().over(Window.partitionBy("image").orderBy("open_time")))

    def y_of(price):
        return (F.lit(80) + F.col("lower") * 180 + F.floor((F.lit(500.0) - price) * 0.3)).cast("int")

    c = c.withColumn("lower", F.col("k") % 2)
    c = c.select("image", (F.col("k") * 10 + 100).alias("x"), "lower", F.when(F.col("close") >= F.col("open"), "UP").otherwise("DOWN").alias("colour"), y_of(F.col("high")).alias("high"), y_of(F.col("low")).alias("low"), y_of(F.greatest("open", "close")).alias("top"), y_of(F.least("open", "close")).alias("bottom"))
    c = written(c, "bars")
    first, last = (lambda half: F.min(F.when(F.col("lower") == half, F.col("high")))), (lambda half: F.max(F.when(F.col("lower") == half, F.col("low"))))
    pages = c.groupBy("image").agg(F.coalesce(F.greatest(F.lit(0), last(0) + 2 - first(1)), F.lit(0)).alias("apart"), *[f(half).alias(f"{n}{half}") for half in (0, 1) for n, f in (("first", first), ("last", last))])
    pages = pages.withColumn("shift", F.greatest(F.lit(0), 60 - F.least("first0", F.col("first1") + F.col("apart"))))
    pages = pages.select("image", "shift", "apart", (F.greatest(F.lit(460), F.greatest("last0", F.col("last1") + F.col("apart")) + 1) + F.col("shift")).alias("end"))
    pages = pages.select("image", "shift", "apart", (F.col("end") + 40).alias("height"), F.lit(520).alias("width"))
    placed, down = c.join(pages, "image"), F.col("shift") + F.col("lower") * F.col("apart")
    parts = [(F.col("x") - 6, F.col("top"), F.lit(13), F.col("bottom")), (F.col("x"), F.col("high"), F.lit(1), F.col("low"))]
    shapes = F.array(*[F.struct((F.lit(z) + 2).alias("z"), x.cast("int").alias("x"), (top + down).cast("int").alias("y"), w.alias("w"), (bottom - top + 1).alias("h"), F.col("colour")) for z, (x, top, w, bottom) in enumerate(parts)])
    bars = placed.select("image", "height", "width", F.explode(shapes).alias("s")).select("image", "height", "width", "s.*")
    page = pages.select("image", "height", "width", F.lit(0).alias("z"), F.lit(60).alias("x"), F.lit(60).alias("y"), F.lit(420).alias("w"), (F.col("height") - 100).alias("h"), F.lit("background").alias("colour"))
    back = F.col("shift") + F.pmod(F.floor(F.col("x") / 10), F.lit(2)) * F.col("apart")
    seen = _moved(vision.visual_candles(_pages(bars.unionByName(page))), pages.select("image", "shift", "apart"), **{y: back for y in ROWS})
    return seen.select("image", "x", "direction", "body_top", "body_bottom", "upper_top", "lower_bottom", "width")


def order_series_features(spark, sf):
    """The structural features of daily candles of the orders, by priority."""
    c = candles.candles(readers.daily_ticks(spark, sf, "orders")).withColumn("is_closed", F.lit(True))
    c = features.structural(c, SESSION, volatility=5, trend=2, lateral=(4, 1.5), bucket="year")
    return c.select("session_id", "open_time", "open", "high", "low", "close", F.round("volatility", 9).alias("volatility"), "trend", "lateral")


def lineitem_candles(spark, sf):
    return candles.candles(readers.daily_ticks(spark, sf, "lineitem")).select("session_id", "open_time", "open", "high", "low", "close", "ticks")


# -- beyond SQL: folds ------------------------------------------------------


def capture_cadence(spark, sf):
    """Frames that are due, an hour apart."""
    f = ticks(spark, sf).select("session_id", F.col("seq").cast("string").alias("frame_id"), F.col("ts").alias("captured_at"))
    return capture.due(f, 3600.0).select("session_id", "frame_id", "is_due")


def conflict_fold(spark, sf):
    """Altered snapshots folded candle by candle in arrival order, which is not quite the order of time."""
    s = _altered(spark, sf)
    text = F.lpad(F.col("seq").cast("string"), 12, "0")
    a = s.select("session_id", F.col("open_time").cast("timestamp").alias("open_time"), (F.col("seq") + F.when(F.col("seq") % 10 == 3, 40).otherwise(0)).alias("arrival"), text.alias("observation_id"), F.lit("events").alias("source_id"), F.col("session_id").alias("asset"), F.lit("1h").alias("timeframe"), (F.col("open_time") + F.expr("INTERVAL 1 HOUR")).cast("timestamp").alias("close_time"), "open", "high", "low", "close", "is_closed", F.col("confidence").alias("vision_confidence"), F.lit(None).cast("double").alias("source_confidence"))
    o = ticks(spark, sf).select(text.alias("observation_id"), "session_id", F.col("ts").cast("timestamp").alias("timestamp"))
    return store.fold_arrivals(a, o).groupBy("session_id", "outcome").agg(F.count("*").alias("arrivals"))


def exact_returns(spark, sf):
    from wickline.functions import exact

    w = features.ordered(SESSION)
    return closing(spark, sf).withColumn("before", F.lag("close").over(w)).select("session_id", "open_time", exact.return_text(F.col("close"), F.col("before")).alias("return_text"))


def exact_volatility(spark, sf):
    from wickline.functions import exact

    return exact.volatility(closing(spark, sf), SESSION, 5).select("session_id", "open_time", F.col("volatility_exact").cast("string").alias("volatility_exact"))


def tracked_frames(spark, sf):
    """A frame a day and session, with a bar for each hour that has a candle, tracked over time."""
    from wickline.operators import tracking

    c = candles_from_ticks(spark, sf).withColumn("day", F.date_trunc("day", "open_time"))
    w = Window.partitionBy("session_id", "day").orderBy("open_time")
    bars = c.withColumn("k", F.row_number().over(w))
    frames = bars.select("session_id", F.date_format("day", "yyyyMMdd").alias("frame_id"), F.date_trunc("hour", F.max("open_time").over(Window.partitionBy("session_id", "day"))).cast("timestamp").alias("captured_at"), (F.col("k") * 10).cast("int").alias("x"), F.lit(0.9).alias("confidence"))
    r = tracking.track(frames, "1h")
    return r.select("session_id", "frame_id", "status", "reason", "shift_px", F.size("new_ids").alias("n_new"), F.size("updated_ids").alias("n_updated"), F.size("closed_ids").alias("n_closed"))


_ALL = (
    candles_from_ticks, snapshots_cumulative, candles_for_frame, candles_as_of, candles_as_of_batched, canonical_latest, latest_snapshot_ts, evolution_violations, same_ts_conflicts,
    constraint_violations, key_duplicates, orphan_audit, idempotent_merge_plan, replay_visible, replay_release_steps, sequence_validation, direction, amplitude, returns, volatility,
    hh_hl_lh_ll, basic_trend, basic_lateralization, data_quality, last_closed, analysis_decision, analysis_evidence, analysis_dense, reconstruction_match, reconstruction_metrics, normalize_dedup,
    ohlc_reject_reasons, bands, frame_change_flags, price_interpolation, anchor_calibration, spacing_shift_median, exposure_frontier, policy_registration, policy_eligibility, outcome_reference,
    outcome_horizon, outcome_state, outcome_evidence, availability_status, confusion_matrix, precision_recall, coverage, confidence_calibration, calibration_gap, chart_reading, order_series_features, lineitem_candles,
    chart_prices, chart_regions, touching_bars, capture_cadence, conflict_fold, exact_returns, exact_volatility, tracked_frames,
)
QUERIES = {f.__name__: f for f in _ALL}

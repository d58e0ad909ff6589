"""Reconstruction metrics: reconstructed candles against the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["session_id", "asset", "timeframe", "open_time"]
FIELDS = ["open", "high", "low", "close"]


def matched(reconstructed: DataFrame, truth: DataFrame) -> DataFrame:
    """Each truth candle with its reconstructed one: of duplicates the last by ``arrival``; null if missing."""
    last = reconstructed.groupBy(*KEY).agg(F.max_by(F.struct(*FIELDS), "arrival").alias("_r"))
    return truth.select(*KEY, *FIELDS).join(last, KEY, "left").select(*KEY, *FIELDS, *[F.col(f"_r.{f}").alias(f"r_{f}") for f in FIELDS], F.col("_r").isNotNull().alias("detected"))


def metrics(reconstructed: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: mean errors (null without pairs), rates and counts (0 over 0 is 0).

    Two truth candles with the same key fail the job.
    """
    def rate(top, bottom):
        return F.coalesce(top / F.nullif(bottom.cast("double"), F.lit(0.0)), F.lit(0.0))

    once = truth.groupBy(*KEY).agg(F.count("*").alias("_n"), *[F.first(f).alias(f) for f in FIELDS])
    once = once.where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit("DUPLICATE_GROUND_TRUTH")).cast("boolean"))).drop("_n")
    pairs = matched(reconstructed, once)
    side = F.signum(F.col("close") - F.col("open")) == F.signum(F.col("r_close") - F.col("r_open"))
    found = pairs.agg(
        F.count("*").alias("truth_count"), F.count_if("detected").alias("matched_count"), F.count_if(side).alias("same_side"),
        *[F.avg(F.abs(F.col(f"r_{f}") - F.col(f))).alias(f"{f}_mean_error") for f in FIELDS],
    )
    groups = reconstructed.groupBy(*KEY).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("reconstructed_count"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))
    return found.join(groups, F.lit(True)).select(
        *[f"{f}_mean_error" for f in FIELDS],
        rate(F.col("matched_count"), F.col("truth_count")).alias("detection_rate"), rate(F.col("same_side"), F.col("matched_count")).alias("direction_accuracy"),
        rate(F.col("surplus"), F.col("reconstructed_count")).alias("duplicate_rate"), rate(F.col("truth_count") - F.col("matched_count"), F.col("truth_count")).alias("missing_rate"),
        "truth_count", "reconstructed_count", "matched_count",
    )

"""Rule classifier with auditable evidence, batched over point-in-time requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wickline.config import AnalysisConfig, plain
from wickline.functions import texts
from wickline.operators import asof, features
from wickline.operators.store import Store
from wickline.scratch import written


def state_rule(minimum: float, trend: str = "trend", lateral: str = "lateral", quality: str = "quality") -> Column:
    """The first rule that applies."""
    q, lat, t = F.col(quality), F.col(lateral), F.col(trend)
    return (
        F.when(q.isNull(), "MISSING_DATA_QUALITY").when(q < minimum, "LOW_DATA_QUALITY")
        .when(lat.isNull(), "MISSING_LATERALIZATION").when(lat, "SIDEWAYS")
        .when(t == features.RISING, features.RISING).when(t == features.FALLING, features.FALLING)
        .otherwise("UNCERTAIN_FALLBACK")
    )


def market_state(rule: Column) -> Column:
    return F.when(rule == "SIDEWAYS", "SIDEWAYS").when(rule == features.RISING, "UP").when(rule == features.FALLING, "DOWN").otherwise("UNCERTAIN")


def evidence(config: AnalysisConfig, persisted: bool) -> Column:
    """Evidence tokens in order; the persisted form ends with the whole configuration."""
    number = F.when(F.col("quality").isNull(), "NONE").otherwise(texts.number_text(F.col("quality")))
    seen = F.when(F.col("lateral").isNull(), "NONE").otherwise(F.upper(F.col("lateral").cast("string")))
    tokens = [
        F.concat(F.lit("STATE_RULE="), F.col("state_rule")), F.concat(F.lit("BASIC_TREND="), F.coalesce("trend", F.lit("NONE"))),
        F.concat(F.lit("BASIC_LATERALIZATION="), seen), F.concat(F.lit("DATA_QUALITY="), number),
    ]
    least = F.lit(f"MINIMUM_DATA_QUALITY={plain(config.minimum_quality) if persisted else float(config.minimum_quality)}")
    if not persisted:
        # a decision for want of history has no token of the threshold
        return F.when(F.col("state_rule") == "INSUFFICIENT_HISTORY", F.array(*tokens)).otherwise(F.array(*tokens, least))
    return F.array(*tokens, F.lit(f"TREND_PAIRS={config.trend_pairs}"), F.lit(f"LATERALIZATION_WINDOW_CANDLES={config.lateral_window}"), F.lit(f"LATERALIZATION_MAX_RANGE_RATIO={plain(config.lateral_max_range)}"), least)


def decide(measured: DataFrame, config: AnalysisConfig, persisted: bool = False) -> DataFrame:
    """Decisions from rows with closed (count), trend, lateral and quality."""
    enough = F.col("closed") >= config.needed
    rule = F.when(~enough, "INSUFFICIENT_HISTORY").otherwise(state_rule(config.minimum_quality))
    out = measured.withColumns({c: F.when(enough, F.col(c)) for c in ("trend", "lateral", "quality")}).withColumn("state_rule", rule)
    out = out.withColumn("market_state", market_state(F.col("state_rule")))
    out = out.withColumn("confidence", F.when(F.col("market_state") == "UNCERTAIN", 0.0).otherwise(F.col("quality")))
    return out.withColumn("evidence", evidence(config, persisted))


def measured(closed: DataFrame, by: list[str], config: AnalysisConfig, bucket: str | None = "day") -> DataFrame:
    """Trend, lateral, quality and number of closed candles (as far as they matter) as of each closed candle."""
    return features.structural(closed, by, trend=config.trend_pairs, lateral=(config.lateral_window, float(config.lateral_max_range)), quality=config.needed, count=True, bucket=bucket)


def analyze(snapshots: DataFrame, requests: DataFrame, config: AnalysisConfig, persisted: bool = False) -> DataFrame:
    """The decision for each request (session_id, as_of), from what was known then.

    The candles are the last closed ones of the as-of read that the
    configuration needs.  A request without any has
    INSUFFICIENT_HISTORY.
    """
    by = ["session_id", "as_of"]
    requests = requests.select(*by).distinct()
    known = asof.recent_closed(snapshots, requests, config.needed)
    last = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("open_time")))
    at_end = measured(known, by, config, bucket=None).withColumn("_last", last).where("_last = 1").select(*by, "closed", "trend", "lateral", "quality")
    return decide(requests.join(at_end, by, "left").withColumn("closed", F.coalesce("closed", F.lit(0))), config, persisted)


def analyze_in_order(snapshots: DataFrame, requests: DataFrame, config: AnalysisConfig, persisted: bool = False) -> DataFrame:
    """The same for histories in which candles close in the order of their open_time.

    Features are computed once a closed candle and written, and each request looks
    up the last candle closed by then: linear in both inputs.
    """
    closing = snapshots.where("is_closed").groupBy("session_id", "open_time").agg(F.min_by(F.struct("ts", "seq", "open", "high", "low", "close", "is_closed", "confidence"), F.struct("ts", "seq")).alias("row")).select("session_id", "open_time", "row.*")
    table = written(measured(closing, ["session_id"], config).select("session_id", "open_time", "ts", "closed", "trend", "lateral", "quality"), "measured")
    requests = requests.select("session_id", "as_of").distinct()
    found = asof.last_known(requests, table, ["session_id"], "as_of", "ts", ["closed", "trend", "lateral", "quality"], tie=["open_time"])
    return decide(found.withColumn("closed", F.coalesce("closed", F.lit(0))), config, persisted)


def analyze_and_record(store: Store, snapshots: DataFrame, requests: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Decide requests (analysis_id, session_id, as_of) and append them to the store's analyses.

    An analysis carries its as_of as timestamp and the persisted evidence.  The
    same analysis again changes nothing; another result under its id is a conflict.
    """
    decided = analyze(snapshots, requests, config, persisted=True)
    rows = requests.select("analysis_id", "session_id", "as_of").join(decided, ["session_id", "as_of"])
    rows = rows.select("analysis_id", "session_id", F.col("as_of").alias("timestamp"), "market_state", "confidence", F.col("quality").alias("data_quality"), "evidence")
    store.append("analyses", rows)
    return rows

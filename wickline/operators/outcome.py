"""Outcomes of analyses at a horizon of closed candles, and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from wickline.functions import texts
from wickline.operators import asof, halo
from wickline.scratch import written

PREDICTED, REALIZED = ["UP", "DOWN", "SIDEWAYS", "UNCERTAIN"], ["UP", "DOWN", "SIDEWAYS"]
# The tokens of an outcome's evidence, in order, with their columns.
EVIDENCE = [
    ("OUTCOME_RULE", "outcome_rule"), ("ANALYSIS_ID", "analysis_id"), ("POLICY_ID", "policy_id"), ("REFERENCE_CANDLE_OPEN_TIME", "reference_open_time"),
    ("REFERENCE_CANDLE_CLOSE_TIME", "reference_close_time"), ("REFERENCE_CLOSE", "reference_close"), ("FINAL_CANDLE_OPEN_TIME", "final_open_time"),
    ("FINAL_CANDLE_CLOSE_TIME", "final_close_time"), ("FINAL_CLOSE", "final_close"), ("HORIZON_CLOSED_CANDLES", "horizon"),
    ("REALIZED_RETURN_THRESHOLD", "threshold"), ("REALIZED_RETURN", "realized_return"), ("REALIZED_STATE", "realized_state"),
]
NUMBERS = ("reference_close", "final_close", "threshold", "realized_return")


def exposure_frontier(sessions: DataFrame, exposures: DataFrame) -> DataFrame:
    """The latest instant that each tracked session has exposed; it never falls, whatever the order of exposures."""
    latest = exposures.groupBy("session_id").agg(F.max("exposed_at").alias("_latest"))
    tracked = F.col("tracking_state") == "TRACKED"
    return sessions.join(latest, "session_id", "left").withColumn("exposure_frontier", F.when(tracked, F.greatest("origin_time", "_latest"))).drop("_latest")


def register_policies(requests: DataFrame, frontier: DataFrame, policies: DataFrame) -> DataFrame:
    """Requests (policy_id, session_id, horizon, threshold) with bound_at and an ``action``.

    A session has one policy, bound at its exposure frontier.  The same request
    again is a noop; another one conflicts; untracked sessions are refused.
    """
    held = policies.select("session_id", F.struct("policy_id", "horizon", "threshold").alias("_held"), F.col("bound_at").alias("_bound"))
    state = frontier.select("session_id", "tracking_state", "exposure_frontier")
    out = requests.join(state, "session_id", "left").join(held, "session_id", "left")
    rivals = F.count("*").over(Window.partitionBy("session_id"))
    same = F.struct("policy_id", "horizon", "threshold").eqNullSafe(F.col("_held"))
    action = F.when(~F.coalesce(F.col("tracking_state") == "TRACKED", F.lit(False)), "refused").when(F.col("_held").isNotNull(), F.when(same, "noop").otherwise("conflict")).when(rivals > 1, "conflict").otherwise("insert")
    return out.withColumn("action", action).withColumn("bound_at", F.when(action == "insert", F.col("exposure_frontier")).otherwise(F.col("_bound"))).drop("_held", "_bound", "tracking_state", "exposure_frontier")


def with_horizon(closed_truth: DataFrame, horizon: int) -> DataFrame:
    """Closed truth candles with the candle ``horizon`` closed ones later; gaps are not filled."""
    truth = closed_truth.select("session_id", "open_time", "close_time", "close")

    def add(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumns({f"final_{c}": F.lead(c, horizon).over(w) for c in ("open_time", "close_time", "close")})

    found = halo.over(truth, ["session_id"], "open_time", add, after=horizon)
    return found.withColumnsRenamed({c: f"reference_{c}" for c in ("open_time", "close_time", "close")}).select("session_id", *REFERENCE)


REFERENCE = ["reference_open_time", "reference_close_time", "reference_close", "final_open_time", "final_close_time", "final_close"]


def realized_state(change: Column, threshold: Column) -> Column:
    return F.when(change > threshold, "UP").when(change < -threshold, "DOWN").when(change.isNotNull(), "SIDEWAYS")


def evaluate(analyses: DataFrame, truth: DataFrame, policies: DataFrame, frontier: DataFrame, horizon: int, evaluated_at, exhausted: Column | None = None) -> DataFrame:
    """Every analysis with its availability, and its outcome where that is AVAILABLE.

    ``analyses`` has analysis_id, session_id, timestamp and the prediction.
    Truth after ``evaluated_at`` is not looked at, and an analysis after it fails the job.  ``exhausted`` says for a
    session whether its source has ended.  Policies of another horizon than
    ``horizon`` belong to another call.
    """
    instant = F.lit(evaluated_at)
    closed = truth.where(F.col("is_closed") & (F.col("close_time") <= instant))
    found = asof.last_known(analyses, with_horizon(closed, horizon), ["session_id"], "timestamp", "reference_close_time", REFERENCE, tie=["reference_open_time"])
    found = found.join(policies.select("session_id", "policy_id", "horizon", "threshold", "bound_at"), "session_id", "left").join(frontier.select("session_id", "tracking_state"), "session_id", "left")
    status = (
        F.when(F.col("timestamp") > instant, F.raise_error(F.lit("evaluated_at is before an analysis")).cast("string"))
        .when(~F.coalesce(F.col("tracking_state") == "TRACKED", F.lit(False)), "EXPOSURE_HISTORY_UNKNOWN")
        .when(F.col("policy_id").isNull(), "UNAVAILABLE_POLICY").when(F.col("bound_at") > F.col("timestamp"), "POLICY_BOUND_TOO_LATE")
        .when(F.col("reference_close").isNull(), "UNAVAILABLE_REFERENCE")
        .when(F.col("final_close").isNull(), F.when(exhausted if exhausted is not None else F.lit(False), "UNAVAILABLE_END_OF_DATASET").otherwise("PENDING_HORIZON"))
        .otherwise("AVAILABLE")
    )
    change = (F.col("final_close") - F.col("reference_close")) / F.nullif(F.col("reference_close").cast("double"), F.lit(0.0))
    out = found.withColumn("status", status).withColumn("realized_return", F.when(F.col("status") == "AVAILABLE", change))
    return out.withColumn("realized_state", realized_state(F.col("realized_return"), F.col("threshold").cast("double")))


def evidence() -> Column:
    """The ordered tokens of an evaluated row."""
    rule = F.when(F.col("realized_state") == "UP", "RETURN_ABOVE_THRESHOLD").when(F.col("realized_state") == "DOWN", "RETURN_BELOW_NEGATIVE_THRESHOLD").otherwise("RETURN_WITHIN_THRESHOLD")
    return F.array(*[F.concat(F.lit(f"{name}="), rule if column == "outcome_rule" else texts.number_text(F.col(column)) if column in NUMBERS else F.col(column).cast("string")) for name, column in EVIDENCE])


def require_one_policy(pairs: DataFrame) -> None:
    """Metrics are of one policy and one configuration."""
    if pairs.select("policy_id", "horizon", "threshold").distinct().limit(2).count() > 1:
        raise ValueError("outcomes of different policies cannot be combined")


def report(outcomes: DataFrame) -> dict[str, DataFrame]:
    """All metrics of evaluated analyses of one policy and configuration.

    ``outcomes`` has status, policy_id, horizon, threshold, market_state, confidence
    and realized_state; rows of other states than AVAILABLE count as availability only.
    """
    outcomes = written(outcomes, "evaluated")  # all metrics read it
    pairs = outcomes.where("status = 'AVAILABLE'")
    require_one_policy(pairs)
    by = ["policy_id"]
    bins = calibration(pairs, by)
    return {
        "availability": outcomes.groupBy("status").agg(F.count("*").alias("analyses")), "confusion": confusion(pairs, by), "scores": scores(pairs, by),
        "calibration": bins, "weighted_gap": weighted_gap(bins, by),
    }


def confusion(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Counts of realized against predicted states, with zeros, in a row for each realized state."""
    p, r = F.col("market_state"), F.col("realized_state")
    names = [f"predicted_{s.lower()}" for s in PREDICTED]
    counts = [F.struct(F.lit(state).alias("realized_state"), *[F.count_if((r == state) & (p == q)).alias(n) for q, n in zip(PREDICTED, names)]) for state in REALIZED]
    return pairs.groupBy(*by).agg(F.array(*counts).alias("rows")).select(*by, F.explode("rows").alias("row")).select(*by, "row.*")


def scores(pairs: DataFrame, by: list[str]) -> DataFrame:
    """accuracy, precision and recall per state, coverage and uncertain frequency; null over 0."""
    def ratio(top: Column, bottom: Column) -> Column:
        return top / F.nullif(bottom.cast("double"), F.lit(0.0))

    p, r = F.col("market_state"), F.col("realized_state")
    sure = F.count_if(p != "UNCERTAIN")
    columns = [F.count("*").alias("evaluated"), F.count_if(p == "UNCERTAIN").alias("uncertain_count"), ratio(F.count_if(p == r), F.count("*")).alias("accuracy"), ratio(sure, F.count("*")).alias("coverage"), ratio(F.count_if(p == "UNCERTAIN"), F.count("*")).alias("uncertain_frequency")]
    for s in REALIZED:
        hit = F.count_if((p == s) & (r == s))
        columns += [ratio(hit, F.count_if(p == s)).alias(f"precision_{s.lower()}"), ratio(hit, F.count_if(r == s)).alias(f"recall_{s.lower()}")]
    return pairs.groupBy(*by).agg(*columns)


def calibration(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Five confidence bins of the predictions that are not UNCERTAIN; bins without any have nulls."""
    bin_ = F.when(F.col("market_state") != "UNCERTAIN", F.least(F.floor(F.col("confidence").cast("decimal(20,10)") * 5), F.lit(4)).cast("int"))
    hit = (F.col("market_state") == F.col("realized_state")).cast("double")
    bins = [F.struct(F.lit(i).alias("bin"), F.count_if(bin_ == i).alias("n"), F.avg(F.when(bin_ == i, F.col("confidence"))).alias("mean_confidence"), F.avg(F.when(bin_ == i, hit)).alias("observed_accuracy")) for i in range(5)]
    out = pairs.groupBy(*by).agg(F.array(*bins).alias("rows")).select(*by, F.explode("rows").alias("row")).select(*by, "row.*")
    return out.withColumn("absolute_gap", F.abs(F.col("mean_confidence") - F.col("observed_accuracy")))


def weighted_gap(bins: DataFrame, by: list[str]) -> DataFrame:
    """Mean gap of the bins by their counts; null without predictions."""
    return bins.groupBy(*by).agg((F.sum(F.col("n") * F.col("absolute_gap")) / F.nullif(F.sum("n").cast("double"), F.lit(0.0))).alias("weighted_alignment_gap"))

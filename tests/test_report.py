import pytest
from pyspark.sql import functions as F

from wickline.operators import outcome

SCHEMA = "analysis_id string, status string, policy_id string, horizon int, threshold double, market_state string, confidence double, realized_state string"
ROWS = [
    ("a", "AVAILABLE", "p", 3, 0.1, "UP", 0.9, "UP"), ("b", "AVAILABLE", "p", 3, 0.1, "UP", 0.7, "DOWN"), ("c", "AVAILABLE", "p", 3, 0.1, "UNCERTAIN", 0.0, "SIDEWAYS"),
    ("d", "PENDING_HORIZON", "p", 3, 0.1, "DOWN", 0.8, None), ("e", "AVAILABLE", "p", 3, 0.1, "SIDEWAYS", 0.5, "SIDEWAYS"),
]


def test_report_of_one_policy(spark):
    got = outcome.report(spark.createDataFrame(ROWS, SCHEMA))
    assert {r.status: r.analyses for r in got["availability"].collect()} == {"AVAILABLE": 4, "PENDING_HORIZON": 1}
    assert {r.realized_state: (r.predicted_up, r.predicted_down, r.predicted_sideways, r.predicted_uncertain) for r in got["confusion"].collect()} == {"UP": (1, 0, 0, 0), "DOWN": (1, 0, 0, 0), "SIDEWAYS": (0, 0, 1, 1)}
    scores = got["scores"].first()
    assert (scores.evaluated, scores.accuracy, scores.coverage, scores.precision_up, scores.recall_down, scores.precision_down) == (4, 0.5, 0.75, 0.5, 0, None)
    bins = {r.bin: (r.n, r.mean_confidence, r.observed_accuracy) for r in got["calibration"].collect()}
    assert bins == {0: (0, None, None), 1: (0, None, None), 2: (1, 0.5, 1.0), 3: (1, 0.7, 0.0), 4: (1, 0.9, 1.0)}
    assert abs(got["weighted_gap"].first().weighted_alignment_gap - (0.5 + 0.7 + 0.1) / 3) < 1e-9


@pytest.mark.parametrize("change", [{"policy_id": "q"}, {"horizon": 4}, {"threshold": 0.2}])
def test_policies_are_not_combined(spark, change):
    other = {n: F.when(F.col("analysis_id") == "a", F.lit(v)).otherwise(F.col(n)) for n, v in change.items()}
    with pytest.raises(ValueError, match="different policies"):
        outcome.report(spark.createDataFrame(ROWS, SCHEMA).withColumns(other))


def test_only_uncertain_predictions_keep_their_bins(spark):
    got = outcome.report(spark.createDataFrame(ROWS[2:3], SCHEMA))
    assert [r.n for r in got["calibration"].orderBy("bin").collect()] == [0] * 5 and got["weighted_gap"].first().weighted_alignment_gap is None

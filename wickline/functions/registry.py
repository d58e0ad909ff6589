"""SQL names for the feature expressions, as SQL functions over columns (no Python in the plan)."""

from __future__ import annotations

from pyspark.sql import SparkSession

# The words that the functions return.
FUNCTIONS = {
    "candle_direction(open DOUBLE, close DOUBLE) RETURNS STRING": "CASE WHEN close > open THEN 'CLOSE_ABOVE_OPEN' WHEN close < open THEN 'CLOSE_BELOW_OPEN' ELSE 'CLOSE_EQUAL_OPEN' END",
    "candle_amplitude(high DOUBLE, low DOUBLE) RETURNS DOUBLE": "high - low",
    "candle_return(now DOUBLE, before DOUBLE) RETURNS DOUBLE": "try_divide(now - before, before)",
    "basic_trend(all_rising BOOLEAN, all_falling BOOLEAN) RETURNS STRING": "CASE WHEN all_rising THEN 'RISING_STRUCTURE' WHEN all_falling THEN 'FALLING_STRUCTURE' WHEN all_rising IS NOT NULL THEN 'MIXED_STRUCTURE' END",
    "basic_lateralization(trend STRING, high DOUBLE, low DOUBLE, first_close DOUBLE, max_range DOUBLE) RETURNS BOOLEAN": "CASE WHEN first_close <> 0 AND trend IS NOT NULL THEN trend = 'MIXED_STRUCTURE' AND (high - low) / abs(first_close) <= max_range END",
}


def register(spark: SparkSession) -> list[str]:
    """Register all as temporary SQL functions and return their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.partition("(")[0] for head in FUNCTIONS]

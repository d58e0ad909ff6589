"""Readers: replay JSON, ground-truth CSV, images, and series made of the driver's tables; databases are in ``database``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickline.operators.candles import reject_reason

_REPLAY = "schema_version int, asset string, timeframe string, candles array<struct<timestamp:string,open:string,high:string,low:string,close:string>>"
_OFFSET = r"(Z|[+-]\d\d:?\d\d)$"


def _fail_unless(ok, message: str):
    return F.when(ok, True).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def replay_json(spark: SparkSession, path: str, source_id: str = "replay", session_id: str = "reference-replay") -> DataFrame:
    """Closed one-minute candles of replay files, with ``ordinal`` for their order in the file.

    A naive timestamp, incoherent prices, another timeframe or an empty list fail the job.
    """
    files = spark.read.option("multiLine", True).schema(_REPLAY).json(path)
    files = files.where(_fail_unless(F.col("timeframe") == "1m", "only the 1m timeframe is supported")).where(_fail_unless(F.size("candles") > 0, "a replay needs candles"))
    rows = files.select("asset", "timeframe", F.posexplode("candles").alias("ordinal", "c"))
    price = "decimal(38,18)"
    rows = rows.where(_fail_unless(F.col("c.timestamp").rlike(_OFFSET), "timestamps must be timezone-aware")).select(
        F.lit(source_id).alias("source_id"), F.lit(session_id).alias("session_id"), "asset", "timeframe", F.to_timestamp("c.timestamp").alias("open_time"),
        *[F.col(f"c.{f}").cast(price).alias(f) for f in ("open", "high", "low", "close")], "ordinal",
    )
    rows = rows.where(F.when(reject_reason().isNull(), True).otherwise(F.raise_error(reject_reason()).cast("boolean")))
    return rows.withColumns({"close_time": F.col("open_time") + F.expr("INTERVAL 1 MINUTE"), "is_closed": F.lit(True), "vision_confidence": F.lit(None).cast("double"), "source_confidence": F.lit(1.0)})


def ground_truth_csv(spark: SparkSession, path: str) -> DataFrame:
    """timestamp, open, high, low, close."""
    schema = T.StructType([T.StructField("timestamp", T.TimestampType())] + [T.StructField(c, T.DecimalType(38, 18)) for c in ("open", "high", "low", "close")])
    return spark.read.csv(path, schema=schema, header=True)


def images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """(path, modificationTime, length, content) of image files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of the events table: a session is an event type, the price its value, candles are hourly."""
    confidence = F.when(F.col("event_id") % 97 != 0, F.lit(0.5) + (F.col("event_id") % 51) / F.lit(100.0))
    return parquet(spark, sf_dir, "events").select(
        F.col("event_type").alias("session_id"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), confidence.alias("confidence"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("open_time"), "user_id",
    )


def daily_ticks(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Ticks of orders (by priority) or lineitem (by return flag) in daily candles, for larger series."""
    if table == "orders":
        rows = parquet(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("session_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"))
    else:
        rows = parquet(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("session_id"), F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"), F.col("l_extendedprice").alias("price"))
    return rows.withColumn("open_time", F.date_trunc("day", "ts").cast("timestamp_ntz")).withColumn("confidence", F.lit(1.0))

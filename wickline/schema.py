"""Schemas of the stored tables, their rules, and audits of them.

Parquet enforces no keys or checks, so rules are predicates: an audit returns
the rows that break one, with the rule's name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE = T.DecimalType(38, 18)
# The market states that an analysis may carry.
MARKET_STATES = ("UP", "DOWN", "SIDEWAYS", "UNCERTAIN")


def _schema(text: str) -> T.StructType:
    """``name type`` fields by commas; ``!`` behind the type: not null."""
    kinds = {"string": T.StringType(), "ts": T.TimestampType(), "int": T.IntegerType(), "bool": T.BooleanType(), "double": T.DoubleType(), "price": PRICE, "strings": T.ArrayType(T.StringType(), False)}
    fields = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, kinds[kind.rstrip("!")], not kind.endswith("!")) for name, kind in fields])


#: Version of the tables below; a change of a column or table is a step of ``wickline.operators.migrations``.
VERSION = 7

CANDLE = "session_id string!, source_id string!, asset string!, timeframe string!, open_time ts!, close_time ts!, open price!, high price!, low price!, close price!, is_closed bool!, vision_confidence double, source_confidence double"
SCHEMAS = {
    "sessions": _schema("session_id string!, source_id string!, asset string!, timeframe string!, started_at ts!, ended_at ts"),
    "frames": _schema("frame_id string!, session_id string!, captured_at ts!, image_hash string!, width int!, height int!, changed_since_previous bool!, storage_reference string"),
    "observations": _schema("observation_id string!, session_id string!, timestamp ts!, frame_id string!, confidence double!, visual_quality double!"),
    "candles": _schema(CANDLE),
    "snapshots": _schema("observation_id string!, " + CANDLE),
    "analyses": _schema("analysis_id string!, session_id string!, timestamp ts!, market_state string!, confidence double!, data_quality double, evidence strings!"),
    "session_exposure": _schema("session_id string!, tracking_state string!, origin_time ts, exposure_frontier ts"),
    "policies": _schema("policy_id string!, session_id string!, horizon int!, threshold price!, bound_at ts!"),
    "outcomes": _schema("analysis_id string!, policy_id string!, evaluated_at ts!, reference_open_time ts!, reference_close_time ts!, reference_close price!, final_open_time ts!, final_close_time ts!, final_close price!, horizon int!, threshold price!, realized_return price!, realized_state string!, evidence strings!"),
}
KEYS = {
    "sessions": ["session_id"], "frames": ["frame_id"], "observations": ["observation_id"], "candles": ["session_id", "open_time"],
    "snapshots": ["observation_id", "session_id", "open_time"], "analyses": ["analysis_id"], "policies": ["policy_id"], "outcomes": ["analysis_id"],
}
#: (child, parent, columns) whose values must stand in the parent.
REFERENCES = [
    ("frames", "sessions", ["session_id"]), ("observations", "sessions", ["session_id"]), ("observations", "frames", ["frame_id", "session_id"]),
    ("candles", "sessions", ["session_id"]), ("snapshots", "observations", ["observation_id", "session_id"]),
    ("snapshots", "candles", ["session_id", "open_time"]), ("analyses", "sessions", ["session_id"]),
]


def filled(name: str) -> Column:
    return F.length(F.trim(F.col(name))) > 0


def within_unit(name: str) -> Column:
    """In [0, 1] and a number; null is left to the schema."""
    c = F.col(name)
    return c.isNull() | (c.between(0, 1) & ~F.isnan(c.cast("double")))


def ohlc_rules() -> dict[str, Column]:
    o, h, lo, c = map(F.col, ("open", "high", "low", "close"))
    return {"HIGH_BELOW_BODY": h >= F.greatest(o, c), "LOW_ABOVE_BODY": lo <= F.least(o, c), "LOW_ABOVE_HIGH": lo <= h}


def rules(table: str) -> dict[str, Column]:
    """Name -> predicate that every row of the table fulfils."""
    names = [f.name for f in SCHEMAS[table].fields]
    out = {f"{n}_empty": filled(n) for n in names if n in ("session_id", "source_id", "asset", "timeframe", "frame_id", "observation_id", "image_hash", "analysis_id", "policy_id")}
    out |= {f"{n}_range": within_unit(n) for n in names if n in ("confidence", "visual_quality", "vision_confidence", "source_confidence", "data_quality")}
    if table == "sessions":
        out["ends_before_start"] = F.col("ended_at").isNull() | (F.col("ended_at") >= F.col("started_at"))
    if table == "frames":
        out |= {"width_not_positive": F.col("width") > 0, "height_not_positive": F.col("height") > 0}
    if table in ("candles", "snapshots"):
        out |= {"closes_before_open": F.col("close_time") > F.col("open_time")} | ohlc_rules()
    if table == "analyses":
        out["market_state_unknown"] = F.col("market_state").isin(*MARKET_STATES)
    return out


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows of ``df`` once for each rule they break, with the rule's name as ``violation``; unknown counts as broken."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    return df.withColumn("violation", F.explode(F.array_compact(broken)))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def orphans(child: DataFrame, parent: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``child`` without a parent."""
    return child.join(parent.select(*columns).distinct(), columns, "left_anti")


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order and type; naive timestamps are refused."""
    naive = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType) and f.name in SCHEMAS[table].fieldNames()]
    if naive:
        raise ValueError(f"{', '.join(naive)} must be timezone-aware")
    return conform_columns(df, table)


def conform_columns(df: DataFrame, table: str, *more: str) -> DataFrame:
    """The table's columns in order and type, and further ones as they are."""
    kinds = {f.name: f.dataType for f in SCHEMAS[table].fields}
    # an array that may hold nulls has no cast to one that may not
    return df.select(*more, *[F.col(n) if df.schema[n].dataType.simpleString() == kind.simpleString() else F.col(n).cast(kind).alias(n) for n, kind in kinds.items()])


def same_payload(a: str, b: str, columns: list[str]) -> Column:
    """Whether all columns of the aliases ``a`` and ``b`` agree, nulls included."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])

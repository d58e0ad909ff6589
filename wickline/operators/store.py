"""Append-only candle store: idempotent inserts, conflicts, and the evolution of candles.

A batch is planned first: each row is an insert, a no-op or a conflict, and
nothing is written if any row conflicts.  A commit is atomic, and there may be
many writers (:mod:`wickline.operators.commits`).
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime
from decimal import Decimal
from typing import TypeVar

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wickline import schema
from wickline.operators import commits
from wickline.scratch import written

T = TypeVar("T")


class Conflict(ValueError):
    """A row contradicts what is stored."""


def merge_plan(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """``incoming`` with an ``action``: insert, noop or conflict.

    Equal rows of one batch are one row; different ones with the same key are conflicts.
    """
    payload = [c for c in incoming.columns if c not in keys]
    new = incoming.distinct()
    copies = F.count("*").over(Window.partitionBy(*keys))
    held = stored.select(*keys, F.struct(*payload).alias("_held"), F.lit(True).alias("_is_held"))
    same = F.struct(*payload).eqNullSafe(F.col("_held"))
    action = F.when(F.col("_copies") > 1, "conflict").when(F.col("_is_held").isNull(), "insert").when(same, "noop").otherwise("conflict")
    return new.withColumn("_copies", copies).join(held, keys, "left").withColumn("action", action).drop("_copies", "_held", "_is_held")


class View:
    """The tables at one version, with what a commit has appended so far."""

    def __init__(self, store: Store, state: commits.State) -> None:
        self.store, self.state = store, state
        self.added: dict[str, list[str]] = {}
        self.touched: set[str] = set()

    def read(self, table: str) -> DataFrame:
        """The table; empty before its first append."""
        self.touched.add(table)
        return self.store._frame(table, self.state.folders.get(table, []) + self.added.get(table, []))

    def append(self, table: str, rows: DataFrame) -> int:
        """Insert what is new and return its count; refuse the batch if any row is invalid or conflicts."""
        rows = schema.conform(rows, table)
        broken = schema.violations(rows, schema.rules(table)).select("violation").limit(1).first()
        if broken:
            raise ValueError(broken[0])
        for child, parent, columns in schema.REFERENCES:
            # candles are the latest snapshots, so those of a snapshot are always there
            if child == table and parent != "candles" and schema.orphans(rows, self.read(parent), columns).limit(1).count():
                raise ValueError(f"{table} without {parent}")
        plan = merge_plan(rows, self.read(table), schema.KEYS[table]).persist()
        try:
            counts = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
            if counts.get("conflict"):
                raise Conflict(f"{counts['conflict']} rows of {table} contradict stored ones")
            if counts.get("insert"):
                self.added.setdefault(table, []).append(self.store.write(table, plan.where("action = 'insert'").drop("action")))
        finally:
            plan.unpersist()
        return counts.get("insert", 0)


class Store:
    """Tables below ``path``: folders of Parquet files that a log of commits names.

    Many writers may commit.  Each works on a view of the newest version and
    becomes visible as a whole or not at all; where another one has changed a
    table that the view has looked at, the work is done again on the new version.
    """

    #: Times that a commit is tried against other writers.
    TRIES = 20

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.log = commits.Log(spark, self.path)

    def healthy(self) -> bool:
        """Whether the session answers."""
        try:
            return self.spark.sql("SELECT 1").first()[0] == 1
        except Exception:
            return False

    def _frame(self, table: str, folders: list[str]) -> DataFrame:
        kind = schema.SCHEMAS[table]
        return self.spark.read.schema(kind).parquet(*folders) if folders else self.spark.createDataFrame([], kind)

    def write(self, table: str, rows: DataFrame) -> str:
        """A new folder of files, which no reader sees before it is committed."""
        folder = f"{self.path}/{table}/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return folder

    def _state(self, version: int | None = None) -> commits.State:
        state = self.log.state(version)
        if state.version and state.schema != schema.VERSION:
            raise ValueError(f"the store's tables are of version {state.schema}, not {schema.VERSION}")
        return state

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table now, or as it was after a version; empty before its first append."""
        return self._frame(table, self._state(version).folders.get(table, []))

    def get(self, table: str, **key) -> dict | None:
        """One row by its key, or None."""
        found = self.read(table)
        for name, value in key.items():
            found = found.where(F.col(name) == F.lit(value))
        row = found.limit(1).first()
        return row.asDict() if row else None

    def commit(self, work: Callable[[View], T]) -> T:
        """What ``work`` returns, once all that it has appended to its view stands in the store.

        If it fails, nothing of it does.  It is called again where another writer was first.
        """
        for _ in range(self.TRIES):
            view = View(self, self._state())
            done = False
            try:
                out = work(view)
                done = not view.added or self._publish(view)
            finally:
                if not done:
                    self.log.drop([f for folders in view.added.values() for f in folders])
            if done:
                return out
        raise Conflict("other writers were always first")

    def _publish(self, view: View) -> bool:
        version = view.state.version
        while True:
            if self.log.publish(version + 1, schema.VERSION, view.added, []):
                return True
            other = self.log.entry(version + 1)
            if other["whole"] or other["remove"] or other["schema"] != schema.VERSION or view.touched & set(other["add"]):
                return False
            version += 1  # it has to do with other tables

    def append(self, table: str, rows: DataFrame) -> int:
        """Insert what is new and return its count; refuse the batch if any row is invalid or conflicts."""
        return self.commit(lambda view: view.append(table, rows))

    def candles(self) -> DataFrame:
        """The canonical candles: the latest state of each by its snapshots."""
        known = self.read("snapshots").join(self.read("observations").select("observation_id", F.col("timestamp").alias("ts"), F.col("observation_id").alias("seq")), "observation_id")
        return canonical(known).select(schema.SCHEMAS["candles"].fieldNames())

    def save_candles(self, arrivals: DataFrame, observations: DataFrame | None = None) -> DataFrame:
        """Fold snapshots (their columns and ``arrival``) into the stored candles and append them, with the observations given.

        The outcome of every arrival is returned, as :func:`fold_arrivals` names
        it.  All or nothing: if one contradicts what is stored or came before it,
        nothing is written, observations neither.  The stored history of the candles
        at hand comes first, in the order of its observations; an arrival that is
        stored already is not stored again.
        """
        def work(view: View) -> DataFrame:
            if observations is not None:
                view.append("observations", observations)
            return self._folded(view, arrivals)

        return self.commit(work)

    def _folded(self, view: View, arrivals: DataFrame) -> DataFrame:
        columns = schema.SCHEMAS["snapshots"].fieldNames()
        new = schema.conform(arrivals, "snapshots").select(*columns)
        broken = schema.violations(new, schema.rules("snapshots")).select("violation").limit(1).first()
        if broken:
            raise ValueError(broken[0])
        seen = view.read("observations")
        touched = new.select("session_id", "open_time").distinct()
        held = view.read("snapshots").join(touched, ["session_id", "open_time"], "left_semi").join(seen.select("observation_id", "timestamp"), "observation_id")
        order = Window.partitionBy("session_id", "open_time").orderBy(F.desc("timestamp"), F.desc("observation_id"))
        held = held.withColumn("arrival", -F.row_number().over(order).cast("long")).select("arrival", *columns)  # before all new ones
        line = schema.conform_columns(arrivals, "snapshots", "arrival").unionByName(held)
        folded = fold_arrivals(line.withColumn("arrival", F.col("arrival").cast("long")), seen).where("arrival >= 0")
        outcomes = written(folded, "outcomes")  # the fold would see the new snapshots as stored if it ran again
        conflict = outcomes.where(F.col("outcome").startswith("CONFLICT")).orderBy("session_id", "open_time", "arrival").first()
        if conflict:
            raise Conflict(f"{conflict['observation_id']}: {conflict['outcome'].removeprefix('CONFLICT:')}")
        fresh = outcomes.where(F.col("outcome") != NOOP).select("observation_id", "session_id", "open_time").distinct()
        view.append("snapshots", new.join(fresh, ["observation_id", "session_id", "open_time"], "left_semi").distinct())
        return outcomes


# -- evolution of candles -------------------------------------------------

IDENTITY = ["source_id", "session_id", "asset", "timeframe", "open_time", "close_time", "open"]
STATE = ["high", "low", "close", "is_closed", "vision_confidence", "source_confidence"]


def canonical(snapshots: DataFrame) -> DataFrame:
    """The latest state of each candle, for histories without conflicts."""
    keys = ["session_id", "open_time"]
    payload = [c for c in snapshots.columns if c not in keys]
    return snapshots.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.struct("ts", "seq")).alias("row")).select(*keys, "row.*")


def latest_knowledge(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("session_id", "open_time").agg(F.max("ts").alias("latest_ts"))


def same_time_conflicts(snapshots: DataFrame, payload: list[str]) -> DataFrame:
    """Candles with more than one state at one knowledge time."""
    return snapshots.groupBy("session_id", "open_time", "ts").agg(F.count_distinct(F.struct(*payload)).alias("states")).where("states > 1")


def evolution_violations(snapshots: DataFrame) -> DataFrame:
    """Snapshots that break an invariant of those before them, in knowledge order, with the first ``violation``."""
    w = Window.partitionBy("session_id", "open_time").orderBy("ts", "seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    state = F.struct("open", "high", "low", "close")
    final = F.first(F.when(F.col("is_closed"), state), ignorenulls=True).over(before)
    broken = (
        F.when(F.col("open") != F.first("open").over(w), "OPEN_CHANGED")
        .when(final.isNotNull() & (~F.col("is_closed") | (state != final)), "CHANGED_AFTER_CLOSE")
        .when(F.col("high") < F.max("high").over(before), "HIGH_FELL")
        .when(F.col("low") > F.min("low").over(before), "LOW_ROSE")
    )
    return snapshots.withColumn("violation", broken).where("violation is not null")


# The outcomes of saving one snapshot.
INSERTED, UNCHANGED, LATE, EVOLVED, NOOP = "INSERTED", "UNCHANGED", "LATE", "EVOLVED", "NOOP"


def payload_text(payload: tuple) -> str:
    """A payload as text that :func:`payload_of` reads back."""
    return json.dumps([x.isoformat() if isinstance(x, datetime) else str(x) if isinstance(x, Decimal) else x for x in payload])


def payload_of(text: str) -> tuple:
    """The payload of a text; times are compared as times, prices as they were."""
    return tuple(_read.get(c, lambda x: x)(x) for c, x in zip(IDENTITY + STATE, json.loads(text)))


def _price(value):
    return Decimal(value) if isinstance(value, str) else value


_read = {c: pd.Timestamp for c in ("open_time", "close_time")} | {c: _price for c in ("open", "high", "low", "close")}


def _plain(value):
    """A value as one kind whatever brought it: no NaN for null, no NumPy numbers."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value.item() if hasattr(value, "item") and not isinstance(value, datetime) else value


class CandleFold:
    """The state of one candle while its snapshots arrive."""

    def __init__(self) -> None:
        self.current: dict | None = None
        self.newest = None
        self.at_time: dict = {}
        self.by_observation: dict = {}

    def payload(self) -> str:
        """The canonical row as text."""
        return payload_text(tuple(self.current[c] for c in IDENTITY + STATE))

    def restore(self, payload: str, newest) -> None:
        """Go on from a canonical row and the newest knowledge time."""
        self.current, self.newest = dict(zip(IDENTITY + STATE, payload_of(payload))), pd.Timestamp(newest)

    def save(self, row: dict) -> str:
        """Outcome of one arrival: a name above, or ``CONFLICT:reason`` that leaves the state as it is."""
        row = row | {c: _plain(row[c]) for c in IDENTITY + STATE}
        payload = tuple(row[c] for c in IDENTITY + STATE)
        if not row["observed"]:
            return "CONFLICT:MISSING_OBSERVATION"
        if row["observed_session"] != row["session_id"]:
            return "CONFLICT:OTHER_SESSION"
        if self.at_time.get(row["ts"], payload) != payload:
            return "CONFLICT:SAME_TIME"
        held = self.by_observation.get(row["observation_id"])
        if held is not None and held != payload:
            return "CONFLICT:SAME_OBSERVATION"
        outcome, now = self._outcome(row, payload)
        if not outcome.startswith("CONFLICT"):
            self.current = now
            self.at_time[row["ts"]] = payload
            self.by_observation[row["observation_id"]] = payload
            self.newest = row["ts"] if self.newest is None else max(self.newest, row["ts"])
            if held is not None and outcome == UNCHANGED:
                return NOOP
        return outcome

    def _outcome(self, row: dict, payload: tuple) -> tuple[str, dict]:
        old, new = self.current, {c: row[c] for c in IDENTITY + STATE}
        if old is None:
            return INSERTED, new
        if tuple(old[c] for c in IDENTITY + STATE) == payload:
            return UNCHANGED, old
        if any(old[c] != new[c] for c in IDENTITY):
            return "CONFLICT:IDENTITY", old
        if row["ts"] <= self.newest:
            # late: the canonical state stays, if what came late could have led to it
            if new["is_closed"]:
                return "CONFLICT:LATE_CLOSED", old
            return (LATE, old) if new["high"] <= old["high"] and new["low"] >= old["low"] else ("CONFLICT:LATE_RANGE", old)
        if old["is_closed"]:
            return "CONFLICT:ALREADY_CLOSED", old
        if new["high"] < old["high"] or new["low"] > old["low"]:
            return "CONFLICT:RANGE_SHRANK", old
        return EVOLVED, new


FOLDED = "session_id string, open_time timestamp, arrival long, observation_id string, outcome string"


def observed(arrivals: DataFrame, observations: DataFrame) -> DataFrame:
    """Arrivals with what their observations say: when, in which session, and whether there are any."""
    seen = observations.select("observation_id", F.col("session_id").alias("observed_session"), F.col("timestamp").alias("ts"), F.lit(True).alias("observed"))
    rows = arrivals.join(seen, "observation_id", "left").withColumn("observed", F.coalesce("observed", F.lit(False)))
    return rows.select("arrival", "observation_id", "observed_session", "ts", "observed", *IDENTITY, *STATE)


def fold_arrivals(arrivals: DataFrame, observations: DataFrame) -> DataFrame:
    """Outcome of every arrival (snapshot columns, ``arrival``), folded per candle in arrival order.

    The arrivals of a candle come to one task in order and are folded as they
    stream by, so a task holds the state of one candle.
    """
    rows = observed(arrivals, observations)
    names = ["session_id", "open_time", "arrival", "observation_id", "outcome"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, CandleFold()
        for batch in batches:
            outcomes = []
            for row in batch.to_pylist():
                if key != (row["session_id"], row["open_time"]):
                    key, state = (row["session_id"], row["open_time"]), CandleFold()
                outcomes.append(state.save(row))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(outcomes, pa.string())], names)

    return rows.repartition("session_id", "open_time").sortWithinPartitions("session_id", "open_time", "arrival").mapInArrow(fold, FOLDED)

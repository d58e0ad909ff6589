"""Versions of the stored tables, and the steps between them.

A store has one version of its tables.  A step up or down is one commit: it adds
or drops tables, or rewrites one in its other form.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickline import schema


@dataclass(frozen=True)
class Step:
    """The tables that a version adds, and those that it holds in another form: (up, down)."""

    name: str
    adds: tuple[str, ...] = ()
    turns: dict[str, tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]] = field(default_factory=dict)


def _array(df: DataFrame) -> DataFrame:
    return df.withColumn("evidence", F.from_json("evidence", T.ArrayType(T.StringType())))


def _text(df: DataFrame) -> DataFrame:
    return df.withColumn("evidence", F.to_json("evidence"))


STEPS = (
    Step("create_sessions", ("sessions",)), Step("create_frames", ("frames",)), Step("create_observations", ("observations",)), Step("create_candles", ("snapshots",)),
    Step("create_analyses", ("analyses",)), Step("evidence_as_array", turns={"analyses": (_array, _text)}), Step("create_outcomes", ("session_exposure", "policies", "outcomes")),
)
assert len(STEPS) == schema.VERSION


def schema_at(table: str, version: int) -> T.StructType:
    """A table's columns in a version that has it."""
    if not any(table in step.adds for step in STEPS[:version]):
        raise ValueError(f"version {version} has no table {table}")
    if table == "analyses" and version < 6:
        return T.StructType([T.StructField(f.name, T.StringType() if f.name == "evidence" else f.dataType, f.nullable) for f in schema.SCHEMAS[table].fields])
    return schema.SCHEMAS[table]


def move(store, target: int) -> int:
    """Bring a store to a version, a commit a step; returns the version it had.

    Going down drops the tables that a version added, with their rows.
    """
    if not 0 <= target <= len(STEPS):
        raise ValueError(f"there is no version {target}")
    start = store.log.state().schema
    while True:
        state = store.log.state()
        if state.schema == target:
            return start
        up = state.schema < target
        version = state.schema + 1 if up else state.schema - 1
        step = STEPS[max(version, state.schema) - 1]
        gone = [] if up else [f for table in step.adds for f in state.folders.get(table, [])]
        made = {}
        for table, turn in step.turns.items():
            held = state.folders.get(table, [])
            if held:
                made[table] = [store.write(table, turn[0 if up else 1](store.spark.read.schema(schema_at(table, state.schema)).parquet(*held)))]
                gone += held
        if not store.log.publish(state.version + 1, version, made, gone):
            store.log.drop([f for folders in made.values() for f in folders])  # another writer was first: look again


def upgrade(store, target: int = len(STEPS)) -> int:
    """Steps up to ``target``."""
    if store.log.state().schema > target:
        raise ValueError(f"the store is above version {target}")
    return move(store, target)


def downgrade(store, target: int) -> int:
    """Steps down to ``target``."""
    if store.log.state().schema < target:
        raise ValueError(f"the store is below version {target}")
    return move(store, target)

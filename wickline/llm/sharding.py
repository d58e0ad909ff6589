"""Minimax contiguous sharding.

Equal texts form atomic groups, in order of their hash.  The smallest feasible
shard capacity over the groups is found by binary search with a greedy check,
and the sequence is cut there.  The driver cannot hold all groups, so it looks
at stretches of the order: at first at ``2^16`` cells of equal width, each one
(bytes, rows) pair.  Where the greedy check stops inside a cell, at the capacity
found or just below it, or where an even cut falls, the cell is divided into 256
and the search repeated, until all these places are borders of single groups.
So the capacity and the cuts are those of the groups themselves, while the driver
holds at most ``2^16`` pairs and 256 for each cell that a cut has touched.

Among the cuts that keep the capacity, each is taken nearest to an even share of
what is left, so that the last shards are not starved.

Slots are numbered without gathering a shard anywhere: rows are counted by shard
and stretch, a stretch of many rows is divided by id, the first slot of each
division comes from the counts, and only its own rows are ordered in one task.
A group of copies with a third of all rows is therefore numbered by many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wickline.llm.common import materialize

#: Bits of the first cells' numbers, and of a division's.
CELL_BITS, DIVIDE_BITS = 16, 8


def greedy_starts(prefix: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """First atom of each shard if ``shards`` shards of ``capacity`` suffice, else None.

    ``prefix`` has the sizes summed up, with a leading 0.
    """
    starts, at, last = [], 0, len(prefix) - 1
    for _ in range(shards):
        starts.append(at)
        at = int(np.searchsorted(prefix, prefix[at] + capacity, side="right")) - 1
        if at >= last:
            return starts + [last] * (shards - len(starts))
    return None


def minimax_capacity(sizes: np.ndarray, shards: int) -> int:
    """The smallest capacity for which a contiguous cut into ``shards`` exists."""
    prefix = np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))])
    low = max(int(sizes.max()) if len(sizes) else 0, -(-int(prefix[-1]) // shards))
    high = max(low, int(prefix[-1]))
    while low < high:
        middle = (low + high) // 2
        if greedy_starts(prefix, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def even_starts(sizes: np.ndarray, shards: int, capacity: int) -> tuple[list[int], set[int]]:
    """First atom of each shard, no shard above ``capacity``, each cut nearest to an even share of the rest.

    Also gives the atoms inside which finer ones could have changed a cut.
    """
    prefix = np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))])
    last = len(prefix) - 1
    least = [last]  # where the shards behind must begin at the earliest to hold the rest
    for _ in range(shards - 1):
        least.append(int(np.searchsorted(prefix, prefix[least[-1]] - capacity, side="left")))
    starts, at, met = [0], 0, {x - 1 for x in least}
    for k in range(1, shards):
        goal = prefix[at] + (prefix[-1] - prefix[at]) / (shards - k + 1)
        near = int(np.searchsorted(prefix, goal))
        if near > at and goal - prefix[near - 1] <= prefix[min(near, last)] - goal:
            near -= 1
        most = int(np.searchsorted(prefix, prefix[at] + capacity, side="right")) - 1
        met |= {int(np.searchsorted(prefix, goal, side="right")) - 1, most}
        at = min(max(near, least[shards - k], at), most, last)
        starts.append(at)
    return starts, met


@dataclass
class Atoms:
    """Stretches of the order of hashes: their number at ``shift`` bits, first and last hash, bytes and rows."""

    shift: np.ndarray
    number: np.ndarray
    first: np.ndarray
    last: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, rows: DataFrame, shift: int) -> Atoms:
        found = rows.groupBy(F.shiftright("hash", shift).alias("number")).agg(F.min("hash").alias("first"), F.max("hash").alias("last"), F.sum("size").alias("size")).toPandas()
        columns = [found[c].to_numpy(np.int64) for c in ("number", "first", "last", "size")]
        return cls(np.full(len(found), shift), *columns)._sorted()

    def _sorted(self) -> Atoms:
        order = np.argsort(self.first)
        return Atoms(*(x[order] for x in (self.shift, self.number, self.first, self.last, self.size)))

    def to_divide(self, shards: int, capacity: int) -> np.ndarray:
        """The atoms of several groups inside which a shard could have to end."""
        prefix = np.concatenate([[0], np.cumsum(self.size)])
        several, total = self.first != self.last, int(prefix[-1])
        alone = int(self.size[~several].max(initial=0))
        low = max(alone, -(-total // shards))
        touched = even_starts(self.size, shards, capacity)[1]
        for share in (capacity, capacity - 1, (low + capacity) // 2, low):
            at = 0
            for _ in range(shards):
                at = int(np.searchsorted(prefix, prefix[at] + share, side="right")) - 1
                touched.add(at)
                if at >= len(self.size) or self.size[at] > share:
                    break
        return np.array(sorted(t for t in touched if 0 <= t < len(self.size) and several[t]), dtype=np.int64)

    def divided(self, rows: DataFrame, where: np.ndarray) -> Atoms:
        """With some atoms replaced by the parts that they consist of."""
        kept = np.setdiff1d(np.arange(len(self.size)), where)
        parts = [Atoms(*(x[kept] for x in (self.shift, self.number, self.first, self.last, self.size)))]
        for shift in np.unique(self.shift[where]):
            own = self.number[where[self.shift[where] == shift]]
            numbers = F.broadcast(rows.sparkSession.createDataFrame([(int(x),) for x in own], "number long"))  # some hundreds
            inside = rows.join(numbers, F.shiftright("hash", int(shift)) == F.col("number"), "left_semi")
            parts.append(Atoms.of(inside, max(0, int(shift) - DIVIDE_BITS)))
        return Atoms(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("shift", "number", "first", "last", "size")))._sorted()


def boundaries(rows: DataFrame, shards: int) -> list[int]:
    """The first hash of each shard but the first, in order; shards that stay empty at the end have none."""
    atoms = Atoms.of(rows, 64 - CELL_BITS)
    if not len(atoms.size):
        return []
    while True:
        capacity = minimax_capacity(atoms.size, shards)
        inside = atoms.to_divide(shards, capacity)
        if not len(inside):
            return [int(atoms.first[s]) for s in even_starts(atoms.size, shards, capacity)[0][1:] if s < len(atoms.size)]
        atoms = atoms.divided(rows, inside)


def shard_documents(docs: DataFrame, shards: int, text: str = "text", key: str = "doc_id", overhead: int = 16, rows_per_task: int = 1_000) -> DataFrame:
    """(key, size, text_crc32, shard, slot) for every row of ``docs``.

    size is the UTF-8 length of the text plus ``overhead``; a null text has no
    bytes and stands in one group with the empty texts.  Repeated rows each get a slot of their own.  An empty
    table gives an empty result.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = materialize(
        docs.select(
            F.col(key).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"),
        ),
        "sized",
    )
    firsts = F.array(*[F.lit(b) for b in boundaries(rows, shards)]).cast("array<bigint>")
    total = rows.count()
    rows_per_task = max(rows_per_task, 2 * total >> CELL_BITS)  # so that there are never more divisions than cells
    bits = min(CELL_BITS, max(1, (total // rows_per_task).bit_length()))
    dealt = rows.withColumns({"shard": F.size(F.filter(firsts, lambda b: b <= F.col("hash"))), "stretch": F.shiftright("hash", 64 - bits)})

    # at most 2^16 + shards rows, and as many divisions
    counts = dealt.groupBy("shard", "stretch").agg(F.count("*").alias("n")).collect()
    parts = {(r["shard"], r["stretch"]): -(-r["n"] // rows_per_task) for r in counts}
    divided = [(s, x, p) for (s, x), p in parts.items() if p > 1]
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    each: dict[tuple, list[int]] = {(r["shard"], r["stretch"]): [r["n"]] for r in counts}
    if divided:
        frame = F.broadcast(spark.createDataFrame(divided, "shard int, stretch long, parts int"))
        for r in dealt.join(frame, ["shard", "stretch"]).groupBy("shard", "stretch", "parts", part.alias("part")).count().collect():
            held = each[r["shard"], r["stretch"]]
            if len(held) != r["parts"]:
                held[:] = [0] * r["parts"]
            held[r["part"]] = r["count"]
    plan, now, slot = [], None, 0
    for shard, stretch in sorted(each):
        now, slot = shard, slot if shard == now else 0
        before = slot + np.concatenate([[0], np.cumsum(each[shard, stretch])])
        plan.append((shard, stretch, parts[shard, stretch], before[:-1].tolist()))
        slot = int(before[-1])
    frame = F.broadcast(spark.createDataFrame(plan, "shard int, stretch long, parts int, before array<bigint>"))
    dealt = dealt.join(frame, ["shard", "stretch"]).withColumn("part", part)
    order = Window.partitionBy("shard", "stretch", "part").orderBy("hash", "doc_id", "size", "text_crc32")
    slot_of = (F.get("before", F.col("part")) + F.row_number().over(order) - 1).cast("long")
    return dealt.select("doc_id", "size", "text_crc32", "shard", slot_of.alias("slot"))

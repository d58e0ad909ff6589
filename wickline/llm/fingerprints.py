"""Document fingerprints from prefix polynomial hashes.

For a text of code points c_0 .. c_{n-1} and a base b modulo the prime
2^31 - 1, the prefix array P_i = sum of c_j b^j for j < i answers any span:
spans of two texts are equal (up to hash chance) if their prefix differences,
scaled to a common power, agree.  Two bases together give 62 bits.  Binary
search over span equality finds the longest common extension of two places.

A fingerprint holds the length, the hash of the whole text and a bottom-k
sketch of the hashes of all spans of ``SPAN`` code points, so fingerprints
alone tell how alike two texts are; equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickline.llm.common import mixed_bits

PRIME = np.uint64((1 << 31) - 1)
BASES = (911_382_323, 972_663_749)
SPAN, KEEP = 16, 64
_SHIFT = np.uint64(31)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, for x under 2^62."""
    x = (x & PRIME) + (x >> _SHIFT)
    x = (x & PRIME) + (x >> _SHIFT)
    return np.where(x >= PRIME, x - PRIME, x)


class Powers:
    """Powers of a base, grown as longer texts come."""

    def __init__(self, base: int) -> None:
        self.base, self.known = base, np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.known) < n:
            top = _mod(self.known[-1:] * np.uint64(self.base))
            self.known = np.concatenate([self.known, _mod(self.known * top)])
        return self.known[:n]


_POWERS = [Powers(b) for b in BASES]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class PrefixHash:
    """Prefix arrays of one text."""

    def __init__(self, points: np.ndarray) -> None:
        self.n = len(points)
        values = points.astype(np.uint64) + np.uint64(1)
        self.prefix = []
        for powers in _POWERS:
            total = np.cumsum(_mod(values * powers.upto(self.n)), dtype=np.uint64)  # under 2^62 up to 2^31 code points
            self.prefix.append(np.concatenate([np.zeros(1, dtype=np.uint64), _mod(total)]))

    def span(self, start: int, length: int) -> tuple[int, ...]:
        """Hash of a span, comparable between all spans after :func:`spans_equal`'s scaling."""
        return tuple(int((int(p[start + length]) - int(p[start])) % int(PRIME)) for p in self.prefix)

    def windows(self, width: int) -> np.ndarray:
        """62-bit hash of every span of ``width``, the same wherever the span stands."""
        count = self.n - width + 1
        if count <= 0:
            return np.zeros(0, dtype=np.uint64)
        out = np.zeros(count, dtype=np.uint64)
        for p, powers in zip(self.prefix, _POWERS):
            scale = powers.upto(count)[::-1]  # b^(count - 1 - start): each span is moved to the last start
            inverse = pow(powers.base, -(count - 1), int(PRIME))
            moved = _mod(_mod(p[width:] + PRIME - p[:count]) * scale)
            out = (out << _SHIFT) | _mod(moved * np.uint64(inverse))
        return out


def spans_equal(a: PrefixHash, i: int, b: PrefixHash, j: int, length: int) -> bool:
    """Whether ``length`` code points from i of a and from j of b agree."""
    if i < 0 or j < 0 or i + length > a.n or j + length > b.n:
        return False
    low = min(i, j)
    for x, y, powers in zip(a.span(i, length), b.span(j, length), _POWERS):
        if x * pow(powers.base, j - low, int(PRIME)) % int(PRIME) != y * pow(powers.base, i - low, int(PRIME)) % int(PRIME):
            return False
    return True


def common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """Length of the longest common extension from i of a and j of b, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if spans_equal(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def bottom(hashes: np.ndarray, keep: int) -> np.ndarray:
    """The ``keep`` smallest distinct of the mixed hashes, in order."""
    mixed = mixed_bits(hashes)
    share = 4.0 * keep / max(1, len(mixed))
    while share < 1:
        few = np.unique(mixed[mixed < np.uint64(int(share * 2.0**64))])
        if len(few) >= keep:
            return few[:keep]
        share *= 8
    return np.unique(mixed)[:keep]


def fingerprint(hashed: PrefixHash) -> str:
    """n:whole:sketch in hex; texts shorter than a span have their whole as the only span."""
    whole = "".join(f"{x:08x}" for x in hashed.span(0, hashed.n))
    sketch = bottom(hashed.windows(min(SPAN, hashed.n)) if hashed.n else np.zeros(0, dtype=np.uint64), KEEP)
    return f"{hashed.n}:{whole}:{sketch.astype('>u8').tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """Estimated share of common spans of two texts, from their fingerprints: 1 for equal ones."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rpartition(":")[2]), dtype=">u8") for f in (a, b))
    if not len(x) or not len(y):
        return 0.0
    both = np.union1d(x, y)[:KEEP]
    return float(np.isin(both, np.intersect1d(x, y)).sum() / len(both))


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as much of the start of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_prefix long"


def _stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole stretches in order, each closed by its guard; a row is compared with the one behind it."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in SCHEMA.split(", ")]
    rows: list[tuple] = []
    held = None
    for batch in batches:
        for stretch, guard, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("stretch", "guard", "doc_id", "text"))):
            if guard and (held is None or held[0] != stretch):
                continue  # further rows of the guard's id
            text = text or ""
            hashed = PrefixHash(code_points(text))
            printed = fingerprint(hashed)
            if held is not None and held[0] == stretch:
                _, old_id, old, old_hash, old_print = held
                new = edited(old, text)
                new_hash = PrefixHash(code_points(new))
                new_print = fingerprint(new_hash)
                rows.append((old_id, len(old), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), old_print, new_print, likeness(old_print, new_print), likeness(old_print, printed), common_extension(old_hash, 0, new_hash, 0)))
            held = None if guard else (stretch, doc_id, text, hashed, printed)
            if len(rows) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)


def _search(cuts: list[int], width: int = 64):
    """An expression for the number of ``cuts`` that a column has reached, looked up in two steps."""
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)] or [[]]
    arrays = F.array(*[F.array(*map(F.lit, map(int, g))).cast("array<bigint>") for g in groups])
    heads = F.array(*[F.lit(int(g[0])) for g in groups[1:]]).cast("array<bigint>")

    def reached(column):
        group = F.size(F.filter(heads, lambda x: x <= column))
        return group * width + F.size(F.filter(F.get(arrays, group), lambda x: x <= column))

    return reached


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", rows_per_stretch: int = 4_000, max_stretches: int = 4_096) -> DataFrame:
    """Fingerprints of every text and of its edit by the next document's text.

    The ids are cut into stretches of consecutive ids at quantiles of a sample
    (40 ids a stretch; the result does not depend on them).
    A stretch is one task's work in order and ends with a guard row, the first
    document of the next stretch (of the first one behind the last), so each
    text is shuffled once and nothing is ordered as a whole.  Only the sample
    and the first id of each stretch, of which there are at most ``max_stretches``, come to
    the driver.

    A task holds two texts at a time, each with some ten numbers a code point.
    Null texts are empty.  Rows with the same id are ordered by text; null ids
    stand last.  A single document is its own next.  An empty table gives an
    empty result.  Other columns are ignored, whatever their names.  All rows of one
    id, or without one, stand in one stretch.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    count = ids.count()
    pieces = max(1, min(max_stretches, -(-count // rows_per_stretch)))
    sample = [r[0] for r in ids.where("doc_id is not null").sample(min(1.0, 40 * pieces / max(1, count)), seed=1).collect()] if pieces > 1 else []
    cuts = sorted(set(np.quantile(sample, np.arange(1, pieces) / pieces, method="lower").tolist())) if sample else []
    stretch_of = _search(cuts)

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("stretch", F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(stretch_of(F.col("doc_id"))))

    firsts = {r[0]: r[1] for r in placed(ids).groupBy("stretch").agg(F.min("doc_id")).collect()}  # a row a stretch
    order = sorted(firsts)
    closes = [(firsts[b], a) for a, b in zip(order, [*order[1:], *order[:1]])]
    spark = docs.sparkSession
    guards = F.broadcast(spark.createDataFrame(closes, "first long, stretch int"))
    guard_rows = rows.join(guards, rows["doc_id"].eqNullSafe(guards["first"])).select("stretch", F.lit(1).alias("guard"), "doc_id", "text")
    whole = placed(rows).select("stretch", F.lit(0).alias("guard"), "doc_id", "text").unionByName(guard_rows)
    dealt = whole.repartitionById(max(1, len(cuts) + 1), F.col("stretch").cast("int")).sortWithinPartitions("stretch", "guard", F.col("doc_id").asc_nulls_last(), "text")
    return dealt.mapInArrow(_stretch, SCHEMA)

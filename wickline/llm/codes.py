"""Vector codes: every part of a vector becomes the number of its nearest codebook entry.

The rows stand in blocks of some thousand vectors, a NumPy column for each
component.  A round is one ``treeAggregate`` over the blocks: within a block the
distances to the entries accumulate dimension by dimension, ``np.add.at`` gathers
the sums and counts of the entries as whole numbers, and these small tensors are
added up a reduction tree, so that the driver gets a few of them at any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickline.llm.common import discard, materialize

#: Vectors of a block, and bytes of its numbers at most.
ROWS, BYTES = 4096, 8 << 20
#: Copies of the totals of a label, among which its rows are dealt.
SALT = 64
LONG = (1 << 63) - 1


def cut(width: int, parts: int) -> int:
    """Components of a part; vectors are padded with 0 to so many times ``parts``."""
    return max(1, -(-width // parts))


def columns(block: bytes, width: int, wide: bool) -> np.ndarray:
    """Components by rows, as int64 or, where sums of squares could overflow, as Python's whole numbers."""
    values = np.frombuffer(block, dtype=np.float64).reshape(width, -1)
    return np.array([[int(x) for x in column] for column in values], dtype=object).reshape(values.shape) if wide else values.astype(np.int64)


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each column of ``part``; ties go to the lower entry."""
    distance = np.zeros((len(book), part.shape[1]), dtype=part.dtype)
    for d, column in enumerate(part):
        off = book[:, d, None] - column[None, :]
        distance += off * off
    entry = distance.argmin(axis=0)
    return entry, distance[entry, np.arange(part.shape[1])]


def totals(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) of every part's entries over the block's vectors."""
    parts, entries, size = books.shape
    sums, counts = np.zeros(books.shape, dtype=books.dtype), np.zeros((parts, entries), dtype=np.int64)
    for p in range(parts):
        part = block[p * size : (p + 1) * size]
        entry, _ = nearest(part, books[p])
        np.add.at(sums[p], entry, part.T)
        np.add.at(counts[p], entry, 1)
    return sums, counts


def moved(books: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Entries at the floor of their means; unused ones stay."""
    used = counts[:, :, None] > 0
    return np.where(used, sums // np.maximum(counts, 1)[:, :, None], books)


def digest(books: np.ndarray) -> str:
    """sha256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.reshape(-1)).encode()).hexdigest()


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(ids, labels, block) of rows (vec_id, label, v), padded to ``size`` components."""
    step = max(1, min(ROWS, BYTES // (8 * size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                values, vectors = np.zeros((some.num_rows, size)), some.column("v")
                if len(vectors.values) and (vectors.value_lengths().to_numpy() == size).all():
                    values = vectors.flatten().to_numpy().reshape(-1, size)
                else:
                    for i, v in enumerate(vectors.to_pylist()):
                        values[i, : len(v)] = v
                yield pa.RecordBatch.from_arrays(
                    [pa.array([some.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([some.column("label").to_pylist()], pa.list_(pa.int64())), pa.array([np.ascontiguousarray(values.T).tobytes()], pa.binary())],
                    ["ids", "labels", "block"],
                )

    return rows.mapInArrow(run, "ids array<long>, labels array<long>, block binary")


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row (vec_id, label, v).

    ``v`` is an array of whole numbers as doubles; rows with a null one take no
    part, rows with a null id or label do.  Codebooks start as the parts of the
    rows with the smallest ids (nulls last, ties by vector); with fewer rows than
    ``entries`` they have fewer entries.  Vectors are padded with 0 to the longest
    one, and to a multiple of ``parts``.  ``code`` has two hex digits a part.
    Repeated rows each count.  Errors are exact, and given as the nearest long.
    ``label_error`` sums the errors of equal labels, nulls together.  An empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.where("v is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v")
    longest, most = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    part = cut(longest or 0, parts)
    width = part * parts
    wide = 4 * (most or 0.0) ** 2 * part >= 2.0**62
    first = [r["v"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    start = np.zeros((len(first), width))
    for i, v in enumerate(first):
        start[i, : len(v)] = v
    books = columns(np.ascontiguousarray(start.T).tobytes(), width, wide).T.reshape(len(first), parts, part).transpose(1, 0, 2)

    blocks = materialize(_blocks(rows, width), "codes-blocks")
    data = blocks.select("block").rdd
    depth = max(2, (max(1, data.getNumPartitions()) - 1).bit_length() // 5 + 1)
    for _ in range(rounds if first else 0):
        held = spark.sparkContext.broadcast(books)  # entries times components: no row of the table more or less changes its size

        def add(total: tuple, row, held=held) -> tuple:
            sums, counts = totals(columns(row["block"], width, wide), held.value)
            return total[0] + sums, total[1] + counts

        zero = np.zeros(books.shape, dtype=books.dtype), np.zeros(books.shape[:2], dtype=np.int64)
        sums, counts = data.treeAggregate(zero, add, lambda a, b: (a[0] + b[0], a[1] + b[1]), depth)
        books = moved(books, sums, counts)
        held.unpersist()

    final = spark.sparkContext.broadcast(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, block in zip(batch.column("ids"), batch.column("labels"), batch.column("block")):
                values, codes, error = columns(block.as_py(), width, wide), [], 0
                for p in range(parts):
                    entry, distance = nearest(values[p * part : (p + 1) * part], final.value[p])
                    codes.append(entry)
                    error = error + distance
                text = np.array(codes, dtype=np.uint8).T.tobytes().hex()
                each = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(each, pa.string()), pa.array([min(LONG, int(e)) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])

    out = materialize(blocks.mapInArrow(coded, "vec_id long, label long, code string, error long"), "codes-coded")
    discard(blocks)
    # the rows of one label are dealt among copies of its total, so that a frequent one is no single key
    summed = out.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    summed = summed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).withColumnRenamed("label", "of")
    dealt = out.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALT)).cast("int"))
    joined = dealt.join(summed, dealt["label"].eqNullSafe(summed["of"]) & (dealt["salt"] == summed["salt"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))

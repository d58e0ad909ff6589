"""Frame capture: pixel hash, change flags and cadence."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wickline.scratch import written

INTERVAL_SECONDS = 5.0


def pixel_hash(width, height, pixels):
    """sha256 over width and height as four big-endian bytes each and the raw pixel bytes; all columns."""
    four = [F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0")) for c in (width, height)]
    return F.sha2(F.concat(*four, pixels), 256)


def captured(frames: DataFrame) -> DataFrame:
    """Captured frames of pictures (frame_id, session_id, captured_at, content, storage_reference), cut to their box (x, y, width, height) where there is one.

    Gives frame_id, session_id, captured_at, image_hash, width, height,
    changed_since_previous, storage_reference and content, a PNG of what was cut.
    A picture that cannot be decoded, or a box beyond it, fails the job.  What
    was cut is written once, as flags and pictures are both read from it.
    """
    from wickline.operators import vision

    kept = ["frame_id", "session_id", "captured_at", "storage_reference"]
    rows = frames.select(*[F.col(c) if c in frames.columns else F.lit(None).cast("string").alias(c) for c in kept], "content", *[(F.col(c) if c in frames.columns else F.lit(None)).cast("int").alias(c) for c in ("x", "y", "width", "height")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                content, *box = (one.column(c)[0].as_py() for c in ("content", "x", "y", "width", "height"))
                pixels = vision.decode_png(content)
                if pixels is None:
                    raise ValueError("the picture is empty or could not be decoded")
                inside = pixels if box == [None] * 4 else vision.box_of(pixels, box)
                if inside is None:
                    raise ValueError("the box must lie within the picture")
                made = [pa.array([x], t) for x, t in ((vision.picture_hash(inside), pa.string()), (inside.shape[1], pa.int32()), (inside.shape[0], pa.int32()), (vision.encode_png(inside), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in kept), *made], [*kept, "image_hash", "width", "height", "content"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    cut = written(rows.mapInArrow(run, f"{kinds}, image_hash string, width int, height int, content binary"), "captured")
    return change_flags(cut).withColumnRenamed("changed", "changed_since_previous").select("frame_id", "session_id", "captured_at", "image_hash", "width", "height", "changed_since_previous", "storage_reference", "content")


def change_flags(frames: DataFrame, bucket: str = "day") -> DataFrame:
    """``changed``: whether a frame's hash differs from its session's frame before; False for the first.

    Frames are ordered within a session's ``bucket`` of time; the first of a bucket
    is compared with the last of the bucket before, of which there is one row each.
    """
    at = frames.withColumn("_bucket", F.date_trunc(bucket, "captured_at"))
    ends = at.groupBy("session_id", "_bucket").agg(F.max_by("image_hash", F.struct("captured_at", "frame_id")).alias("_end"))
    before = ends.withColumn("_end", F.lag("_end").over(Window.partitionBy("session_id").orderBy("_bucket")))
    w = Window.partitionBy("session_id", "_bucket").orderBy("captured_at", "frame_id")
    last = F.when(F.row_number().over(w) == 1, F.col("_end")).otherwise(F.lag("image_hash").over(w))
    return at.join(before, ["session_id", "_bucket"]).withColumn("changed", F.coalesce(F.col("image_hash") != last, F.lit(False))).select(*frames.columns, "changed")


def interval_micros(interval_seconds: float) -> int:
    """An interval in microseconds; it must be positive."""
    if interval_seconds <= 0:
        raise ValueError("interval_seconds must be positive")
    return round(interval_seconds * 1_000_000)


def due(frames: DataFrame, interval_seconds: float = INTERVAL_SECONDS) -> DataFrame:
    """``is_due``: whether the interval has passed since the last frame that was due.

    A fold per session, streamed in order: a task holds one instant.
    """
    micros = interval_micros(interval_seconds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, last = None, None
        for batch in batches:
            out = []
            for name, at in zip(batch.column("session_id").to_pylist(), batch.column("captured_at").cast(pa.timestamp("us", batch.schema.field("captured_at").type.tz)).cast(pa.int64()).to_pylist()):
                if name != session:
                    session, last = name, None
                take = last is None or at - last >= micros
                last = at if take else last
                out.append(take)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], [*batch.schema.names, "is_due"])

    kept = frames.select("session_id", "frame_id", "captured_at")
    ordered = kept.repartition("session_id").sortWithinPartitions("session_id", "captured_at", "frame_id")
    return ordered.mapInArrow(run, f"session_id string, frame_id string, captured_at {kept.schema['captured_at'].dataType.simpleString()}, is_due boolean")

"""Chart images to candles in pixels.

``read`` takes each picture once: decoded, judged, its chart and scales found,
the runs of its candles' colours told apart by connected region, and the labels
of its scale read.  One row an image comes out, with nothing of the pixels but
those runs; all that follows is relational work on such rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wickline.operators import price_labels, regions
from wickline.operators.png import decode as decode_png
from wickline.operators.png import encode as encode_png

# The colours of a chart (red, green, blue) and how far a pixel may be off.
COLOURS = {"background": ((15, 23, 42), 8), "border": ((51, 65, 85), 8), "UP": ((34, 197, 94), 12), "DOWN": ((239, 68, 68), 12)}
# Least sides of a chart, its least share of the image; least side and quality of an image, and of a candles' box.
CHART_WIDTH, CHART_HEIGHT, CHART_SHARE, IMAGE_SIDE, QUALITY, BOX_SIDE, BOX_QUALITY = 120, 80, 0.15, 64, 0.08, 32, 0.02
# Least size of a candle, share of its width that a row of its body fills, thresholds of an edge.
CANDLE_WIDTH, CANDLE_HEIGHT, CANDLE_AREA, BODY_SHARE, EDGE = 3, 5, 8, 0.55, (40, 120)

READ = (
    "image string, width int, height int, image_hash string, status string, visual_quality double, x int, y int, chart_width int, chart_height int, price_scale_x int, "
    "candles_width int, candles_height int, confidence double, box_quality double, bars array<struct<direction: string, region: int, y: int, x: int, w: int>>, "
    "labels array<struct<y: int, price: double, confidence: double>>"
)


def mask(pixels: np.ndarray, colour: str) -> np.ndarray:
    """Where a picture has one of the chart's colours."""
    shade, off = COLOURS[colour]
    return (np.abs(pixels.astype(np.int16) - np.array(shade, dtype=np.int16)) <= off).all(axis=2)


def quality(pixels: np.ndarray, side: int = IMAGE_SIDE) -> float:
    """Contrast and edges, 0 to 1; 0 for pictures with a side below ``side``."""
    if min(pixels.shape[:2]) < side:
        return 0.0
    shade = regions.grey(pixels)
    return min(1.0, 0.55 * min(1.0, float(shade.std()) / 48) + 0.45 * min(1.0, 8 * float(regions.edges(shade, *EDGE).mean())))


def chart_box(background: np.ndarray, page: tuple[int, int] | None = None) -> tuple[int, int, int, int] | None:
    """(x, y, width, height) of the largest box around a region of background that is large enough; of equal ones the lowest.

    Its share is that of a ``page`` (height, width), or of the picture itself.
    """
    found = regions.boxes(regions.closed(background))
    area = found[:, 2] * found[:, 3]
    whole = page[0] * page[1] if page else background.size
    fine = np.flatnonzero((found[:, 2] >= CHART_WIDTH) & (found[:, 3] >= CHART_HEIGHT) & (area / whole >= CHART_SHARE))
    return tuple(map(int, found[fine[len(fine) - 1 - np.argmax(area[fine][::-1])]])) if len(fine) else None


def scale_line(counts: np.ndarray, start: float, across: int) -> int | None:
    """Where most border is within the outer part of a chart, if there is a fifth of the chart's extent ``across`` of it."""
    first, last = int(len(counts) * start), max(int(len(counts) * start) + 1, int(len(counts) * 0.97))
    at = first + int(np.argmax(counts[first:last]))
    return at if counts[at] >= max(12, int(across * 0.2)) else None


def read_picture(content: bytes | None, templates: dict[str, np.ndarray], page: tuple[int, int] | None = None) -> dict:
    """What :func:`read` gives of one picture, without its name."""
    out = {"status": "LOW_IMAGE_QUALITY", "visual_quality": 0.0, "confidence": 0.0, "bars": [], "labels": []}
    pixels = decode_png(content)
    if pixels is None:
        return out
    height, width = pixels.shape[:2]
    out |= {"width": width, "height": height, "image_hash": picture_hash(pixels), "visual_quality": quality(pixels)}
    if out["visual_quality"] < QUALITY:
        return out
    background = mask(pixels, "background")
    box = chart_box(background, page)
    if box is None:
        return out | {"status": "CHART_NOT_FOUND"}
    x, y, w, h = box
    border = mask(pixels[y : y + h, x : x + w], "border")
    price = scale_line(border.sum(axis=0), 0.5, h)
    inner = w if price is None else max(1, price)
    time = scale_line(border[:, :inner].sum(axis=1), 0.55, inner)
    depth = h if time is None else max(1, time)
    candles = pixels[y : y + depth, x : x + inner]
    for direction in ("UP", "DOWN"):
        row, start, end = regions.runs(mask(candles, direction))
        region = regions.labelled(row, start, end)
        out["bars"] += [{"direction": direction, "region": r, "y": b + y, "x": a + x, "w": e - a} for r, b, a, e in zip(region.tolist(), row.tolist(), start.tolist(), end.tolist())]
    if price is not None:
        left = x + price + 1
        out["labels"] = [{"y": y + b, "price": float(t), "confidence": c} for b, t, c in price_labels.read_labels(pixels[y : y + h, left : max(left + 1, x + w)], templates)]
    return out | {
        "status": "OK", "x": x, "y": y, "chart_width": w, "chart_height": h, "price_scale_x": price, "candles_width": inner, "candles_height": depth,
        "confidence": min(1.0, 0.55 + 0.45 * float(background[y : y + h, x : x + w].mean())), "box_quality": quality(candles, BOX_SIDE),
    }


def picture_hash(pixels: np.ndarray) -> str:
    """sha256 over width and height as four big-endian bytes each and the pixels' blue, green and red."""
    height, width = pixels.shape[:2]
    return hashlib.sha256(width.to_bytes(4, "big") + height.to_bytes(4, "big") + np.ascontiguousarray(pixels[:, :, ::-1]).tobytes()).hexdigest()


def read(images: DataFrame, font: dict[str, str] | None = None, page: tuple[int, int] | None = None) -> DataFrame:
    """One row an image (image, content), as ``READ`` says; what was read already is given back as it is.

    ``status`` is that of the chart, and nothing else but the quality, size and
    hash is known of failed ones.  A chart's share is that of a ``page`` (height,
    width) where pictures are larger than the page they show.  Several steps that use the result should share
    one that is written (:func:`wickline.scratch.written`).
    """
    if "bars" in images.columns:
        return images
    templates = price_labels.templates(font or price_labels.FONT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("image").to_pylist(), batch.column("content")):
                yield pa.RecordBatch.from_pylist([read_picture(content.as_py(), templates, page) | {"image": name}], schema=kinds)

    kinds = pa.schema([
        *((n, pa.string()) for n in ("image",)), ("width", pa.int32()), ("height", pa.int32()), ("image_hash", pa.string()), ("status", pa.string()), ("visual_quality", pa.float64()),
        *((n, pa.int32()) for n in ("x", "y", "chart_width", "chart_height", "price_scale_x", "candles_width", "candles_height")), ("confidence", pa.float64()), ("box_quality", pa.float64()),
        ("bars", pa.list_(pa.struct([("direction", pa.string()), *((n, pa.int32()) for n in ("region", "y", "x", "w"))]))),
        ("labels", pa.list_(pa.struct([("y", pa.int32()), ("price", pa.float64()), ("confidence", pa.float64())]))),
    ])
    return images.select(F.col("image").cast("string").alias("image"), "content").mapInArrow(run, READ)


def facts(images: DataFrame) -> DataFrame:
    """(image, width, height, visual_quality, image_hash); width is null if it can't be decoded."""
    return read(images).select("image", "width", "height", "visual_quality", "image_hash")


def charts(images: DataFrame, page: tuple[int, int] | None = None) -> DataFrame:
    """One row an image: status, chart box, right end and lower end of the candles' box, confidence and quality.

    The chart is the largest box around a connected region of background.  Its
    price scale is the column, and its time scale the row, with the most border in the outer part.
    """
    return read(images, page=page).select("image", "status", "visual_quality", "image_hash", "x", "y", "chart_width", "chart_height", "price_scale_x", "candles_width", "candles_height", "confidence")


def visual_candles(images: DataFrame) -> DataFrame:
    """(image, x, direction, body_top, body_bottom, upper_top, lower_bottom, width, confidence) of every candle in a chart.

    A candle is a connected region of one colour.  Its body reaches from the first
    to the last row that fills most of the region's width; wicks reach beyond.
    Charts with a failed status, and boxes of too low a quality, have no candles.
    """
    bars = read(images).where((F.col("status") == "OK") & (F.col("box_quality") >= BOX_QUALITY)).select("image", F.explode("bars").alias("b")).select("image", "b.*")
    of = ["image", "direction", "region"]
    # an image's rows stay together from here on: all later groups and windows are within it
    lines = bars.repartition("image").groupBy(*of, "y").agg(F.sum("w").alias("n"), F.min("x").alias("first"), F.max(F.col("x") + F.col("w") - 1).alias("last"))
    whole = Window.partitionBy(*of)
    left, right = F.min("first").over(whole), F.max("last").over(whole)
    wide = F.col("n") >= F.greatest(F.lit(2), F.ceil((right - left + 1) * BODY_SHARE))
    lines = lines.withColumn("wide", wide)
    top, bottom = F.min(F.when(F.col("wide"), F.col("y"))).over(whole), F.max(F.when(F.col("wide"), F.col("y"))).over(whole)
    lines = lines.withColumn("inside", F.col("y").between(top, bottom))
    inside = F.col("inside")
    found = lines.groupBy(*of).agg(
        F.min("first").alias("left"), F.max("last").alias("right"), F.min("y").alias("top"), F.max("y").alias("bottom"), F.sum("n").alias("area"),
        F.min(F.when(inside, F.col("y"))).alias("body_top"), F.max(F.when(inside, F.col("y"))).alias("body_bottom"),
        F.min(F.when(inside, F.col("first"))).alias("body_left"), F.max(F.when(inside, F.col("last"))).alias("body_right"),
    )
    width, height, body_width = F.col("right") - F.col("left") + 1, F.col("bottom") - F.col("top") + 1, F.col("body_right") - F.col("body_left") + 1
    found = found.where((width >= CANDLE_WIDTH) & (height >= CANDLE_HEIGHT) & (F.col("area") >= CANDLE_AREA) & F.col("body_top").isNotNull() & (body_width >= CANDLE_WIDTH))
    confidence = F.least(F.lit(1.0), 0.65 + 0.2 * F.least(F.lit(1.0), body_width / 8.0) + 0.15 * F.least(F.lit(1.0), F.col("area") / (width * height)))
    return found.select(
        "image", (F.col("body_left") + F.floor(body_width / 2)).cast("int").alias("x"), "direction", "body_top", "body_bottom",
        F.when(F.col("top") < F.col("body_top"), F.col("top")).alias("upper_top"), F.when(F.col("bottom") > F.col("body_bottom"), F.col("bottom")).alias("lower_bottom"), body_width.cast("int").alias("width"), confidence.alias("confidence"),
    )


def region_fits(x: Column, y: Column, width: Column, height: Column, image_width: Column, image_height: Column) -> Column:
    """Whether a box has an area and lies within its image."""
    return (x >= 0) & (y >= 0) & (width > 0) & (height > 0) & (x + width <= image_width) & (y + height <= image_height)


def box_of(pixels: np.ndarray | None, box: list) -> np.ndarray | None:
    """The pixels within (x, y, width, height), or None where they do not fit."""
    if pixels is None or None in box:
        return None
    x, y, w, h = box
    fits = min(x, y) >= 0 < min(w, h) and x + w <= pixels.shape[1] and y + h <= pixels.shape[0]
    return pixels[y : y + h, x : x + w] if fits else None


def cropped(images: DataFrame) -> DataFrame:
    """Images (image, content, x, y, width, height) cut to their box and encoded again; content is null where the box does not fit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, *box in zip(*(batch.column(c).to_pylist() for c in ("image", "content", "x", "y", "width", "height"))):
                inside = box_of(decode_png(content), box)
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([None if inside is None else encode_png(inside)], pa.binary())], ["image", "content"])

    return images.select(F.col("image").cast("string").alias("image"), "content", "x", "y", "width", "height").mapInArrow(run, "image string, content binary")


def observe(images: DataFrame) -> DataFrame:
    """One row an image: status of the chart, else that of its candles; candles as an array; least confidence and quality."""
    seen = read(images)
    candles = visual_candles(seen).groupBy("image").agg(F.array_sort(F.collect_list(F.struct("x", "direction", "body_top", "body_bottom", "upper_top", "lower_bottom", "width", "confidence"))).alias("candles"), F.avg("confidence").alias("_candles"))
    out = seen.select("image", "status", "visual_quality", "box_quality", F.col("confidence").alias("_chart")).join(candles, "image", "left")
    status = F.when(F.col("status") != "OK", F.col("status")).when(F.col("box_quality") < BOX_QUALITY, "LOW_IMAGE_QUALITY").when(F.col("candles").isNull(), "CANDLE_DETECTION_FAILED").otherwise("OK")
    return out.select("image", status.alias("status"), F.least("visual_quality", "box_quality").alias("visual_quality"), "candles", F.when(status == "OK", F.least("_chart", "_candles")).otherwise(0.0).alias("confidence"))

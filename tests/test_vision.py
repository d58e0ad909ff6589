import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wickline.operators import png, price_scale, regions, vision

# (centre x, high y, low y, body top, body bottom, direction): bars drawn into the chart
BARS = [(230, 180, 380, 220, 340, "UP"), (365, 160, 300, 200, 260, "DOWN"), (500, 240, 400, 240, 330, "UP")]


def picture(bars=BARS):
    image = np.full((560, 800, 3), 255, dtype=np.uint8)
    image[60:480, 80:720] = vision.COLOURS["background"][0]
    image[60:480, 640] = vision.COLOURS["border"][0]
    image[440, 80:640] = vision.COLOURS["border"][0]
    for x, high, low, top, bottom, direction in bars:
        image[high : low + 1, x] = vision.COLOURS[direction][0]
        image[top : bottom + 1, x - 6 : x + 7] = vision.COLOURS[direction][0]
    return image


def images(spark, **pictures):
    return spark.createDataFrame([(k, None if v is None else bytearray(v if isinstance(v, bytes) else vision.encode_png(v))) for k, v in pictures.items()], "image string, content binary")


def filtered(pixels, kinds):
    """Lines of bytes with filters, a byte at a time."""
    height, width, step = pixels.shape
    flat, lines = pixels.reshape(height, -1).astype(int), []
    for y in range(height):
        line = []
        for i in range(width * step):
            left, up, corner = (flat[y, i - step] if i >= step else 0), (flat[y - 1, i] if y else 0), (flat[y - 1, i - step] if y and i >= step else 0)
            p = left + up - corner
            paeth = left if abs(p - left) <= abs(p - up) and abs(p - left) <= abs(p - corner) else up if abs(p - up) <= abs(p - corner) else corner
            line.append((flat[y, i] - [0, left, up, (left + up) // 2, paeth][kinds[y]]) % 256)
        lines.append(line)
    return np.array(lines, dtype=np.uint8)


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (9, 7, 3)).astype(np.uint8)
    assert (vision.decode_png(vision.encode_png(pixels)) == pixels).all()
    for kinds in (np.array([4, 3, 2, 1, 0, 4, 4, 3, 1]), np.array([1, 2, 0, 1, 2, 2, 1, 0, 1])):
        got = png.unfiltered(kinds, filtered(pixels, kinds), 3)
        assert (got == pixels.reshape(9, -1)).all()


def file_of(depth, colour, lines, palette=None):
    def chunk(kind, content):
        return struct.pack(">I", len(content)) + kind + content + bytes(4)

    head = struct.pack(">IIBBBBB", 5, len(lines), depth, colour, 0, 0, 0)
    return png.SIGNATURE + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + line for line in lines)))


def test_other_kinds_of_png():
    palette = bytes(range(48))
    indexed = vision.decode_png(file_of(4, 3, [bytes([0x01, 0x23, 0xF0])], palette))
    assert indexed[0].tolist() == [[3 * i, 3 * i + 1, 3 * i + 2] for i in (0, 1, 2, 3, 15)]
    assert vision.decode_png(file_of(1, 0, [bytes([0b10110000])]))[0, :, 0].tolist() == [255, 0, 255, 255, 0]
    assert vision.decode_png(file_of(16, 0, [bytes([9, 1, 8, 1, 7, 1, 6, 1, 5, 1])]))[0, :, 1].tolist() == [9, 8, 7, 6, 5]
    assert vision.decode_png(file_of(8, 4, [bytes([9, 255, 8, 0, 7, 1, 6, 1, 5, 1])]))[0, :, 2].tolist() == [9, 8, 7, 6, 5]
    assert vision.decode_png(file_of(8, 6, [bytes(range(20))]))[0].tolist() == [[4 * i, 4 * i + 1, 4 * i + 2] for i in range(5)]
    assert vision.decode_png(file_of(8, 5, [bytes(20)])) is None and vision.decode_png(file_of(3, 0, [bytes(20)])) is None and vision.decode_png(file_of(8, 3, [bytes([0, 1, 2, 3, 99])], palette)) is None


def flood(mask):
    """Regions by flooding, pixel by pixel."""
    seen, out = np.zeros(mask.shape, dtype=int), []
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        out.append([])
        todo = [(y, x)]
        seen[y, x] = len(out)
        while todo:
            v, u = todo.pop()
            out[-1].append((v, u))
            for b in range(max(0, v - 1), min(mask.shape[0], v + 2)):
                for a in range(max(0, u - 1), min(mask.shape[1], u + 2)):
                    if mask[b, a] and not seen[b, a]:
                        seen[b, a] = len(out)
                        todo.append((b, a))
    return out


@pytest.mark.parametrize("share", [0.0, 0.2, 0.45, 0.6, 1.0])
def test_regions_are_those_of_a_flood(share):
    mask = np.random.default_rng(int(share * 100)).random((40, 37)) < share
    y, start, end = regions.runs(mask)
    region = regions.labelled(y, start, end)
    got = {}
    for r, v, a, b in zip(region, y, start, end):
        got.setdefault(r, []).extend((v, u) for u in range(a, b))
    assert sorted(sorted(p) for p in got.values()) == sorted(sorted(p) for p in flood(mask))
    boxes = {(min(x for _, x in p), min(v for v, _ in p), max(x for _, x in p) - min(x for _, x in p) + 1, max(v for v, _ in p) - min(v for v, _ in p) + 1) for p in flood(mask)}
    assert {tuple(b) for b in regions.boxes(mask)} == boxes


def test_a_long_spiral_is_one_region():
    mask = np.zeros((61, 61), dtype=bool)
    for i in range(0, 30, 2):  # rings with a gap, joined to the next
        mask[i, i : 61 - i] = mask[60 - i, i : 61 - i] = mask[i : 61 - i, i] = mask[i : 61 - i, 60 - i] = True
        mask[i + 1, i + 1] = True
    assert len(regions.boxes(mask)) == len(flood(mask)) == 1


def canny(shade, low, high):
    """Edges pixel by pixel."""
    height, width = shade.shape
    p = np.pad(shade.astype(int), 1, mode="edge")
    dx, dy, steep = (np.zeros((height, width), dtype=int) for _ in range(3))
    for y in range(height):
        for x in range(width):
            n = p[y : y + 3, x : x + 3]
            dx[y, x] = n[0, 2] + 2 * n[1, 2] + n[2, 2] - n[0, 0] - 2 * n[1, 0] - n[2, 0]
            dy[y, x] = n[2, 0] + 2 * n[2, 1] + n[2, 2] - n[0, 0] - 2 * n[0, 1] - n[0, 2]
            steep[y, x] = abs(dx[y, x]) + abs(dy[y, x])

    def at(y, x):
        return steep[y, x] if 0 <= y < height and 0 <= x < width else 0

    ridge = np.zeros((height, width), dtype=bool)
    for y in range(height):
        for x in range(width):
            m, a, b = int(steep[y, x]), abs(int(dx[y, x])), abs(int(dy[y, x])) << 15
            if m <= low:
                continue
            if b < a * 13573:
                ridge[y, x] = m > at(y, x - 1) and m >= at(y, x + 1)
            elif b > a * 13573 + (a << 16):
                ridge[y, x] = m > at(y - 1, x) and m >= at(y + 1, x)
            else:
                s = -1 if (dx[y, x] < 0) != (dy[y, x] < 0) else 1
                ridge[y, x] = m > at(y - 1, x - s) and m > at(y + 1, x + s)
    out = np.zeros((height, width), dtype=bool)
    for pixels in flood(ridge):
        if any(steep[v, u] > high for v, u in pixels):
            for v, u in pixels:
                out[v, u] = True
    return out


def test_edges_are_those_of_a_plain_version():
    rng = np.random.default_rng(4)
    smooth = np.cumsum(np.cumsum(rng.integers(-9, 10, (30, 33)), axis=0), axis=1) % 256
    for shade in (rng.integers(0, 256, (25, 31)), rng.integers(0, 40, (30, 20)), smooth, np.full((5, 5), 9)):
        shade = shade.astype(np.uint8)
        assert (regions.edges(shade, 40, 120) == canny(shade, 40, 120)).all()


def test_closing():
    rng = np.random.default_rng(5)
    mask = rng.random((20, 23)) < 0.3
    wide = np.array([[mask[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].any() for x in range(23)] for y in range(20)])
    want = np.array([[wide[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].all() for x in range(23)] for y in range(20)])
    assert (regions.closed(mask) == want).all()


@pytest.mark.parametrize("data", [None, b"", b"no picture", vision.encode_png(np.zeros((4, 4, 3), np.uint8))[:40], b"\x89PNG\r\n\x1a\n" + zlib.compress(b"x")])
def test_what_is_no_picture(data):
    assert vision.decode_png(data) is None


def test_facts(spark):
    pixels = picture()
    row = vision.facts(images(spark, a=pixels)).first()
    want = hashlib.sha256((800).to_bytes(4, "big") + (560).to_bytes(4, "big") + pixels[:, :, ::-1].tobytes()).hexdigest()
    assert (row.width, row.height, row.image_hash) == (800, 560, want) and row.visual_quality > 0.4


def test_chart_and_candles(spark):
    df = images(spark, a=picture())
    chart = vision.charts(df).first()
    assert (chart.status, chart.x, chart.y, chart.chart_width, chart.chart_height) == ("OK", 80, 60, 640, 420)
    assert (chart.price_scale_x, chart.candles_height) == (560, 380)
    got = [tuple(r)[1:7] for r in vision.visual_candles(df).orderBy("x").collect()]
    assert got == [(230, "UP", 220, 340, 180, 380), (365, "DOWN", 200, 260, 160, 300), (500, "UP", 240, 330, None, 400)]


def test_the_larger_of_two_charts_is_read(spark):
    page = np.full((600, 900, 3), 255, dtype=np.uint8)
    page[20:200, 20:400] = page[230:560, 60:700] = vision.COLOURS["background"][0]
    page[580, 890] = vision.COLOURS["background"][0]  # a stray pixel
    page[300:380, 200:213] = vision.COLOURS["UP"][0]
    page[50:120, 100:113] = vision.COLOURS["DOWN"][0]  # in the smaller chart
    chart = vision.charts(images(spark, a=page)).first()
    assert (chart.status, chart.x, chart.y, chart.chart_width, chart.chart_height) == ("OK", 60, 230, 640, 330)
    assert [(r.x, r.direction) for r in vision.visual_candles(images(spark, a=page)).collect()] == [(206, "UP")]


def test_bars_that_share_columns_come_apart_and_touching_ones_do_not(spark):
    page = picture([])
    green, red = (vision.COLOURS[c][0] for c in ("UP", "DOWN"))
    page[100:150, 200:213] = page[170:220, 206:219] = green  # columns overlap, 20 rows between
    page[100:150, 300:313] = page[150:200, 313:326] = green  # corners touch
    page[250:300, 200:213] = green
    page[300:350, 200:213] = red  # colours are apart
    page[250:252, 400:440] = page[260:290, 405:407] = green  # too low, too narrow
    got = sorted(tuple(r)[1:6] for r in vision.visual_candles(images(spark, a=page)).drop("upper_top").collect())
    assert [g[:4] for g in got] == [(206, "DOWN", 300, 349), (206, "UP", 100, 149), (206, "UP", 250, 299), (212, "UP", 170, 219)]  # the joined pair fills no row's greater part


def test_failures_have_a_status(spark):
    noise = np.indices((560, 800)).sum(axis=0) // 20 % 2 * 255
    gridded = picture([])
    gridded[100:430:30, 80:640] = (30, 41, 59)
    df = images(spark, gridded=gridded, empty=None, bad=b"xx", plain=np.full((560, 800, 3), 200, np.uint8), noise=np.repeat(noise[:, :, None], 3, axis=2).astype(np.uint8), bare=picture([]), fine=picture())
    got = {r.image: r.status for r in vision.observe(df).collect()}
    assert got == {"empty": "LOW_IMAGE_QUALITY", "bad": "LOW_IMAGE_QUALITY", "plain": "LOW_IMAGE_QUALITY", "noise": "CHART_NOT_FOUND", "bare": "LOW_IMAGE_QUALITY", "gridded": "CANDLE_DETECTION_FAILED", "fine": "OK"}  # a box of one colour has no quality


def test_pixels_to_prices(spark):
    """Labels 105, 100, 95, 90 stand at y = 140, 240, 340, 440."""
    visual = vision.visual_candles(images(spark, a=picture()))
    anchors = spark.createDataFrame([("a", y, p, 0.97) for y, p in ((140, 105.0), (240, 100.0), (340, 95.0), (440, 90.0))], "image string, y int, price double, confidence double")
    scale = price_scale.calibrate(anchors, ["image"])
    up = price_scale.map_candles(visual, anchors, ["image"], scale).orderBy("x").select("open", "high", "low", "close", F.col("confidence") <= 0.97).first()
    assert tuple(up) == (95.0, 103.0, 93.0, 101.0, True)


def test_boxes_and_crops(spark):
    boxes = [(0, 0, 10, 20, True), (790, 0, 10, 5, True), (791, 0, 10, 5, False), (-1, 0, 5, 5, False), (0, 0, 0, 5, False)]
    df = spark.createDataFrame([(str(i), bytearray(vision.encode_png(picture())), *b[:4]) for i, b in enumerate(boxes)], "image string, content binary, x int, y int, width int, height int")
    fits = df.select("image", vision.region_fits(F.col("x"), F.col("y"), F.col("width"), F.col("height"), F.lit(800), F.lit(560)).alias("ok")).collect()
    assert [r.ok for r in sorted(fits, key=lambda r: r.image)] == [b[4] for b in boxes]
    for r in vision.cropped(df).collect():
        x, y, w, h, ok = boxes[int(r.image)]
        assert (r.content is not None) == ok
        if ok:
            assert (vision.decode_png(bytes(r.content)) == picture()[y : y + h, x : x + w]).all()

"""Reading the price labels of a chart's scale.

A label is a band of rows with bright pixels, its digits are bands of columns.
Each digit is brought to one size and compared with templates of the digits by
the share of pixels they have in common.  The templates are drawn from a font,
so any renderer's digits can be read once its font is given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickline.operators.png import decode as decode_png

# Brightness of text, size of a compared digit, least height of a label, least likeness of a digit.
BRIGHT, SIZE, LEAST_HEIGHT, LEAST_LIKENESS = 100, (20, 14), 5, 0.58

#: A plain font of the digits, seven rows of five dots each.
FONT = {
    "0": ".###. #...# #..## #.#.# ##..# #...# .###.", "1": "..#.. .##.. ..#.. ..#.. ..#.. ..#.. .###.",
    "2": ".###. #...# ....# ..##. .#... #.... #####", "3": "####. ....# ....# .###. ....# ....# ####.",
    "4": "...#. ..##. .#.#. #..#. ##### ...#. ...#.", "5": "##### #.... ####. ....# ....# #...# .###.",
    "6": ".###. #.... #.... ####. #...# #...# .###.", "7": "##### ....# ...#. ..#.. ..#.. .#... .#...",
    "8": ".###. #...# #...# .###. #...# #...# .###.", "9": ".###. #...# #...# .#### ....# ....# .###.",
}


def glyph(dots: str, scale: int = 1) -> np.ndarray:
    """A digit of a font as an array of truth values."""
    rows = np.array([[c == "#" for c in row] for row in dots.split()])
    return np.kron(rows, np.ones((scale, scale), dtype=bool))


def write_label(page: np.ndarray, text: str, x: int, bottom: int, colour: tuple, scale: int = 1, font: dict[str, str] = FONT) -> None:
    """Draw a number into an image, its lowest row at ``bottom``."""
    for digit in text:
        dots = glyph(font[digit], scale)
        page[bottom - dots.shape[0] + 1 : bottom + 1, x : x + dots.shape[1]][dots] = colour
        x += dots.shape[1] + 2 * scale


def _inner(dots: np.ndarray) -> np.ndarray:
    """Without its empty margins, at the compared size."""
    rows, columns = np.flatnonzero(dots.any(axis=1)), np.flatnonzero(dots.any(axis=0))
    dots = dots[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1]
    at = [np.minimum((np.arange(n) + 0.5) * m / n, m - 1).astype(int) for n, m in zip(SIZE, dots.shape)]
    return dots[np.ix_(*at)]


def templates(font: dict[str, str]) -> dict[str, np.ndarray]:
    """The digits of a font at the compared size."""
    return {d: _inner(glyph(dots)) for d, dots in font.items()}


def _stretches(on: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last place of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    yield from zip(edges[::2], edges[1::2] - 1)


def read_labels(region: np.ndarray, digits: dict[str, np.ndarray], least: float = LEAST_LIKENESS) -> list[tuple[int, str, float]]:
    """(lowest row, digits, likeness of the least like one) of each label in a region of an image."""
    bright = region @ np.array([0.299, 0.587, 0.114]) > BRIGHT
    found = []
    for top, bottom in _stretches(bright.any(axis=1)):
        if bottom - top + 1 < LEAST_HEIGHT:
            continue
        line, read = bright[top : bottom + 1], []
        for left, right in _stretches(line.any(axis=0)):
            shape = _inner(line[:, left : right + 1])
            like = {d: (shape & t).sum() / (shape | t).sum() for d, t in digits.items()}
            read.append(max(like.items(), key=lambda x: x[1]))
        if read and min(x for _, x in read) >= least:
            found.append((int(bottom), "".join(d for d, _ in read), float(min(x for _, x in read))))
    return found


def price_labels(regions: DataFrame, font: dict[str, str] = FONT, least: float = LEAST_LIKENESS) -> DataFrame:
    """Anchors (image, y, price, confidence) of images (image, content, x, y, width, height).

    The box is that of the price scale.  Images that cannot be decoded, or
    whose box does not fit, have none.
    """
    digits = templates(font)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, *box in zip(*(batch.column(c).to_pylist() for c in ("image", "content", "x", "y", "width", "height"))):
                pixels, (x, y, w, h) = decode_png(content), box
                if pixels is None or None in box or min(x, y) < 0 or min(w, h) < 1 or x + w > pixels.shape[1] or y + h > pixels.shape[0]:
                    continue
                labels = read_labels(pixels[y : y + h, x : x + w], digits, least)
                columns = [[name] * len(labels), [y + b for b, _, _ in labels], [float(t) for _, t, _ in labels], [c for _, _, c in labels]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.float64(), pa.float64()))], ["image", "y", "price", "confidence"])

    return regions.select(F.col("image").cast("string").alias("image"), "content", "x", "y", "width", "height").mapInArrow(run, "image string, y int, price double, confidence double")

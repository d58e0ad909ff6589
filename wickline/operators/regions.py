"""Connected regions, closing and edges of one picture, as array work on masks and their runs."""

from __future__ import annotations

import numpy as np

# Weights of red, green and blue in grey and their sum, in units of 2^-15; the tangent of 22.5 degrees in the same.
GREY, UNIT, TANGENT = np.array([9798, 19235, 3735]), 15, 13573


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, first x, x behind the last) of the true stretches of each line, line by line."""
    steps = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    y, start = np.nonzero(steps == 1)
    return y, start, np.nonzero(steps == -1)[1]


def labelled(y: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The region of each run, by the number of its first run: runs that touch, also by a corner, are of one region."""
    n = len(y)
    if not n:
        return np.zeros(0, dtype=np.int64)
    span = int(end.max()) + 2
    below = (y + 1).astype(np.int64) * span
    first = np.searchsorted(y.astype(np.int64) * span + end, below + start)
    behind = np.searchsorted(y.astype(np.int64) * span + start, below + end, side="right")
    touching = np.maximum(behind - first, 0)
    upper = np.repeat(np.arange(n), touching)
    lower = np.arange(len(upper)) - np.repeat(np.cumsum(touching) - touching, touching) + np.repeat(first, touching)
    region = np.arange(n)
    while True:
        one, two = region[upper], region[lower]
        low, high = np.minimum(one, two), np.maximum(one, two)
        if (low == high).all():
            return region
        np.minimum.at(region, high, low)
        while (region[region] != region).any():
            region = region[region]


def boxes(mask: np.ndarray) -> np.ndarray:
    """(x, y, width, height) of the box of each region of a mask, in the order of their first runs."""
    y, start, end = runs(mask)
    names, of = np.unique(labelled(y, start, end), return_inverse=True)
    low, high = np.full((len(names), 2), np.iinfo(np.int64).max), np.zeros((len(names), 2), dtype=np.int64)
    np.minimum.at(low, of, np.column_stack([start, y]))
    np.maximum.at(high, of, np.column_stack([end, y + 1]))
    return np.concatenate([low, high - low], axis=1)


def _spread(mask: np.ndarray) -> np.ndarray:
    wide = np.pad(mask, 1)
    wide = wide[:, :-2] | wide[:, 1:-1] | wide[:, 2:]
    return wide[:-2] | wide[1:-1] | wide[2:]


def closed(mask: np.ndarray) -> np.ndarray:
    """The mask spread by a pixel and then shrunk by one; what is outside the picture does not shrink it."""
    return ~_spread(~_spread(mask))


def grey(pixels: np.ndarray) -> np.ndarray:
    return ((pixels.astype(np.int64) @ GREY + (1 << UNIT - 1)) >> UNIT).astype(np.uint8)


def _slopes(shade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel differences along x and y; the picture's rim is repeated outside it."""
    p = np.pad(shade.astype(np.int32), 1, mode="edge")
    along, across = p[:-2] + 2 * p[1:-1] + p[2:], p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return along[:, 2:] - along[:, :-2], across[2:] - across[:-2]


def edges(shade: np.ndarray, low: int, high: int) -> np.ndarray:
    """Canny's edges of a grey picture: ridges of the slope above ``low`` that hang together with one above ``high``."""
    dx, dy = _slopes(shade)
    steep = np.abs(dx) + np.abs(dy)
    rim = np.pad(steep, 1)
    height, width = steep.shape

    def beside(down: int, right: int) -> np.ndarray:
        return rim[1 + down : 1 + down + height, 1 + right : 1 + right + width]

    x, y = np.abs(dx).astype(np.int64), np.abs(dy).astype(np.int64) << UNIT
    flat, upright = y < x * TANGENT, y > x * TANGENT + (x << UNIT + 1)
    falling = (dx ^ dy) < 0
    ridge = np.select(
        [flat, upright, falling],
        [(steep > beside(0, -1)) & (steep >= beside(0, 1)), (steep > beside(-1, 0)) & (steep >= beside(1, 0)), (steep > beside(-1, 1)) & (steep > beside(1, -1))],
        (steep > beside(-1, -1)) & (steep > beside(1, 1)),
    )
    ridge = ridge.astype(bool) & (steep > low)
    line, start, end = runs(ridge)
    region = labelled(line, start, end)
    strong = np.concatenate([np.zeros((height, 1), dtype=np.int64), np.cumsum(steep * ridge > high, axis=1)], axis=1)
    held = np.zeros(len(region), dtype=bool)
    np.logical_or.at(held, region, strong[line, end] > strong[line, start])
    keep = held[region]
    out = np.zeros((height, width + 1), dtype=np.int8)
    np.add.at(out, (line[keep], start[keep]), 1)
    np.add.at(out, (line[keep], end[keep]), -1)
    return np.cumsum(out, axis=1)[:, :-1].astype(bool)

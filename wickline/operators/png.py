"""PNG to pixels and back, as array work."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# A file's first bytes, and the samples of a pixel by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PALETTE, GREY = 3, (0, 4)


def decode(data: bytes | None) -> np.ndarray | None:
    """Height x width x 3 bytes of a PNG that is not interlaced; None if it is none.

    Alpha is dropped; of 16 bits the upper 8 are taken, and less than 8 are spread.
    """
    if not data or not data.startswith(SIGNATURE):
        return None
    at, head, body, palette = len(SIGNATURE), b"", [], b""
    try:
        while at < len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            content, at = data[at + 8 : at + 8 + size], at + size + 12
            if kind == b"IHDR":
                head = content
            elif kind == b"PLTE":
                palette = content
            elif kind == b"IDAT":
                body.append(content)
        width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
        samples = SAMPLES[colour]
        if interlaced or not width or not height or depth not in (1, 2, 4, 8, 16):
            return None
        step, length = max(1, samples * depth // 8), -(-width * samples * depth // 8)
        lines = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(height, length + 1)
        values = unfiltered(lines[:, 0], lines[:, 1:], step)
        if depth == 16:
            values = values[:, ::2]
        elif depth < 8:
            bits = np.unpackbits(values, axis=1).reshape(height, -1, depth)
            values = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, : width * samples]
            if colour != PALETTE:
                values = values * (255 // ((1 << depth) - 1))
        pixels = values.reshape(height, width, samples)
        if colour == PALETTE:
            return np.frombuffer(palette, dtype=np.uint8).reshape(-1, 3)[pixels[:, :, 0]]
    except (struct.error, zlib.error, KeyError, IndexError, ValueError):
        return None
    return np.repeat(pixels[:, :, :1], 3, axis=2) if colour in GREY else np.ascontiguousarray(pixels[:, :, :3])


def unfiltered(kinds: np.ndarray, lines: np.ndarray, step: int) -> np.ndarray:
    """Lines without their filters; ``step`` is the distance of a byte to that of the pixel before.

    A byte needs the one to its left and two of the line above, so all those of a
    falling diagonal can be taken at once.
    """
    height, length = lines.shape
    if kinds.max(initial=0) > 4:
        raise ValueError("no such filter")
    if kinds.max(initial=0) <= 2:
        out = lines.copy()
        for y, kind in enumerate(kinds):
            if kind == 1:
                out[y] = np.cumsum(np.pad(lines[y], (0, -length % step)).reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:length]
            elif kind == 2 and y:
                out[y] = lines[y] + out[y - 1]
        return out
    width = -(-length // step)
    raw = np.pad(lines, ((0, 0), (0, width * step - length))).reshape(height, width, step).astype(np.int16)
    out = np.zeros((height + 1, width + 1, step), dtype=np.int16)
    for diagonal in range(height + width - 1):
        y = np.arange(max(0, diagonal - width + 1), min(height, diagonal + 1))
        x, kind = diagonal - y, kinds[y][:, None]
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        off_left, off_up, off_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((off_left <= off_up) & (off_left <= off_corner), left, np.where(off_up <= off_corner, up, corner))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, nearest], 0)
        out[y + 1, x + 1] = (raw[y, x] + guess) & 255
    return out[1:, 1:].reshape(height, -1)[:, :length].astype(np.uint8)


def encode(pixels: np.ndarray) -> bytes:
    """An 8-bit RGB PNG of height x width x 3 bytes."""
    height, width, _ = pixels.shape

    def chunk(kind: bytes, content: bytes) -> bytes:
        return struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(kind + content))

    lines = np.concatenate([np.zeros((height, 1), dtype=np.uint8), pixels.reshape(height, -1).astype(np.uint8)], axis=1)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")

"""Grey page images for recognition: PNG in and out, noise taken away, edges sharpened, and a local threshold."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MARK = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunks(data: bytes):
    at = len(MARK)
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        yield kind, data[at + 8 : at + 8 + size]
        at += size + 12


def _rows(raw: bytes, h: int, width: int, step: int) -> np.ndarray:
    """Bytes of the rows, each row's filter undone."""
    out = np.zeros((h, width), np.uint8)
    above = np.zeros(width, np.uint8)
    for y in range(h):
        begin = y * (width + 1)
        kind, line = raw[begin], np.frombuffer(raw, np.uint8, width, begin + 1)
        if kind == 1:
            line = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            line = _predicted(kind, line.tolist(), above.tolist(), step)
        out[y] = above = np.asarray(line, np.uint8)
    return out


def _predicted(kind: int, line: list[int], above: list[int], step: int) -> list[int]:
    for i, x in enumerate(line):
        a, b, c = (line[i - step], above[i], above[i - step]) if i >= step else (0, above[i], 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        line[i] = (x + guess) & 255
    return line


def decode(data: bytes) -> np.ndarray:
    """The grey values of a PNG with 8 bits a channel that is not interlaced; colours by their luminance."""
    if data[:8] != MARK:
        raise ValueError("no PNG")
    parts = list(_chunks(data))
    w, h, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", parts[0][1])
    if depth != 8 or interlaced or kind not in CHANNELS:
        raise ValueError("a kind of PNG that is not read")
    n = CHANNELS[kind]
    rows = _rows(zlib.decompress(b"".join(d for k, d in parts if k == b"IDAT")), h, w * n, n).reshape(h, w, n)
    if kind == 3:
        palette = np.frombuffer(next(d for k, d in parts if k == b"PLTE"), np.uint8).reshape(-1, 3)
        rows = palette[rows[..., 0]]
    if rows.shape[2] < 3:
        return rows[..., 0]
    return np.rint(rows[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def encode(grey: np.ndarray) -> bytes:
    h, w = grey.shape
    lines = np.zeros((h, w + 1), np.uint8)
    lines[:, 1:] = grey
    chunk = lambda kind, d: struct.pack(">I", len(d)) + kind + d + struct.pack(">I", zlib.crc32(kind + d))
    return MARK + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def smoothed(grey: np.ndarray, radius: int, sigma: float, edge: str) -> np.ndarray:
    """Gaussian means of each place, rows and columns one after the other; ``edge`` says how the image goes on outside."""
    weights = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    weights /= weights.sum()
    out = grey.astype(np.float64)
    for axis in (0, 1):
        pad = [(radius, radius) if a == axis else (0, 0) for a in (0, 1)]
        wide = np.pad(out, pad, mode=edge if out.shape[axis] > radius else "edge")
        size = out.shape[axis]
        out = sum(weight * np.take(wide, range(k, k + size), axis) for k, weight in enumerate(weights))
    return out


def cleaned(grey: np.ndarray, denoise: bool = True, sharpen: bool = True, binarize: bool = False) -> np.ndarray:
    """The median of 3 by 3, then 1.5 times the image less half of its means (sigma 3), then black or white.

    A place is white if it is above the mean around it (31 by 31, sigma 5) less 15.
    """
    if denoise:
        wide = np.pad(grey, 1, mode="edge")
        h, w = grey.shape
        grey = np.median(np.stack([wide[y : y + h, x : x + w] for y in range(3) for x in range(3)]), axis=0).astype(np.uint8)
    if sharpen:
        means = np.rint(smoothed(grey, 9, 3.0, "reflect"))
        grey = np.clip(np.rint(1.5 * grey - 0.5 * means), 0, 255).astype(np.uint8)
    if binarize:
        means = np.rint(smoothed(grey, 15, 5.0, "edge"))
        grey = np.where(grey.astype(np.int16) > means - 15, 255, 0).astype(np.uint8)
    return grey


def preprocessed(data: bytes, **steps: bool) -> bytes:
    """A PNG through ``cleaned``."""
    return encode(cleaned(decode(data), **steps))

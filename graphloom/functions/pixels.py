"""PNG files as arrays of pixels and back, cut and resized, in numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Fixed values of the format: its first bytes, and the channels of a colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunks(data: bytes):
    at = len(SIGNATURE)
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return a if pa <= pb and pa <= pc else b if pb <= pc else c


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row's bytes from what its filter left of them; step is the bytes of a pixel."""
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if kind == 2:
        return row + above
    out = [0] * step + row.tolist()
    up = [0] * step + above.tolist()
    for k in range(step, len(out)):
        left = out[k - step]
        guess = (left + up[k]) // 2 if kind == 3 else _paeth(left, up[k], up[k - step])
        out[k] = (out[k] + guess) & 255
    return np.array(out[step:], np.uint8)


def decoded(data: bytes) -> np.ndarray:
    """(height, width, 3) of a PNG file with eight bits a channel and no interlacing, without its transparency; ValueError for others."""
    if not data.startswith(SIGNATURE):
        raise ValueError("no PNG file")
    body, header = [], None
    for kind, part in _chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
    if header is None or header[2] != 8 or header[3] not in CHANNELS or header[6]:
        raise ValueError("a kind of PNG file that is not read")
    width, height, step = header[0], header[1], CHANNELS[header[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * step)
    out, above = np.empty((height, width * step), np.uint8), np.zeros(width * step, np.uint8)
    for y in range(height):
        above = out[y] = _unfiltered(int(raw[y, 0]), raw[y, 1:], above, step)
    out = out.reshape(height, width, step)
    return np.ascontiguousarray(out[:, :, :3] if step >= 3 else np.repeat(out[:, :, :1], 3, axis=2))


def encoded(pixels: np.ndarray) -> bytes:
    """A PNG file of (height, width, 3) bytes."""
    height, width, _ = pixels.shape
    rows = np.concatenate((np.zeros((height, 1), np.uint8), pixels.reshape(height, width * 3)), axis=1)
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def cut(pixels: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """What lies in a box (x1, y1, x2, y2), to the nearest pixels; black where it is outside of the image.  ValueError for an empty box."""
    x1, y1, x2, y2 = (round(v) for v in box)
    if x2 <= x1 or y2 <= y1:
        raise ValueError("an empty box")
    out = np.zeros((y2 - y1, x2 - x1, 3), np.uint8)
    height, width, _ = pixels.shape
    a, b, c, d = max(x1, 0), max(y1, 0), min(x2, width), min(y2, height)
    if a < c and b < d:
        out[b - y1 : d - y1, a - x1 : c - x1] = pixels[b:d, a:c]
    return out


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    near, far = (1.5 * x - 2.5) * x * x + 1, ((-0.5 * x + 2.5) * x - 4) * x + 2
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


def _weights(size: int, new: int) -> np.ndarray:
    """What each of size places gives to each of new ones: a cubic around its centre, as wide as a new place at least."""
    ratio = size / new
    spread = max(ratio, 1.0)
    centre = (np.arange(new) + 0.5) * ratio
    w = _cubic((np.arange(size)[None, :] + 0.5 - centre[:, None]) / spread)
    return w / w.sum(axis=1, keepdims=True)


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    across = np.einsum("wx,yxc->ywc", _weights(pixels.shape[1], width), pixels.astype(np.float64))
    both = np.einsum("hy,ywc->hwc", _weights(pixels.shape[0], height), across)
    return np.clip(np.rint(both), 0, 255).astype(np.uint8)

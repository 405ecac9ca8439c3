"""PNG files, cut-outs and sizes against plain versions."""

import struct
import zlib

import numpy as np
import pytest

from graphloom.functions import pixels as P


def png(rows, width, height, kind):
    """A file of filtered rows, each with its filter's number first."""
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    packed = zlib.compress(b"".join(rows))
    return P.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:]) + chunk(b"IEND", b"")


def filtered(raw, step, kinds):
    """Rows of bytes filtered by the definitions."""
    out, above = [], [0] * raw.shape[1]
    for row, kind in zip(raw.tolist(), kinds, strict=True):
        made = []
        for k, x in enumerate(row):
            a, b, c = row[k - step] if k >= step else 0, above[k], above[k - step] if k >= step else 0
            guess = [0, a, b, (a + b) // 2, min((a, b, c), key=lambda v: (abs(a + b - c - v), (a, b, c).index(v)))][kind]
            made.append((x - guess) % 256)
        out.append(bytes([kind, *made]))
        above = row
    return out


@pytest.mark.parametrize("kind", P.CHANNELS)
def test_all_filters(kind):
    rng, step = np.random.default_rng(kind), P.CHANNELS[kind]
    raw = rng.integers(0, 256, (10, 7 * step)).astype(np.uint8)
    got = P.decoded(png(filtered(raw, step, [0, 1, 2, 3, 4, 4, 3, 2, 1, 0]), 7, 10, kind))
    want = raw.reshape(10, 7, step)
    assert (got == (want[:, :, :3] if step >= 3 else np.repeat(want[:, :, :1], 3, axis=2))).all()
    assert (P.decoded(P.encoded(got)) == got).all()


def test_cut_and_resize():
    image = np.random.default_rng(1).integers(0, 256, (20, 30, 3)).astype(np.uint8)
    assert (P.cut(image, (2.4, 3, 9.6, 8)) == image[3:8, 2:10]).all()
    over = P.cut(image, (-2, 15, 4, 25))
    assert over.shape == (10, 6, 3) and (over[:5, 2:] == image[15:, :4]).all() and not over[5:].any() and not over[:, :2].any()
    with pytest.raises(ValueError):
        P.cut(image, (5, 5, 5, 9))
    assert (P.resized(image, 30, 20) == image).all()
    assert (P.resized(np.full((9, 7, 3), 200, np.uint8), 16, 3) == 200).all()
    ramp = np.repeat(np.arange(0, 200, 10, dtype=np.uint8)[None, :, None], 4, axis=0).repeat(3, axis=2)
    small = P.resized(ramp, 5, 4)[0, :, 0].astype(int)
    assert np.abs(np.diff(small)[1:-1] - 40).max() <= 1 and abs(small.mean() - ramp[0, :, 0].mean()) < 2
    for bad in (b"", b"GIF89a", P.SIGNATURE):
        with pytest.raises(ValueError):
            P.decoded(bad)


def test_images_are_never_broadcast(spark, data):
    """The join of boxes with images that are made from a small table sends no images to the driver."""
    from graphloom.plans import file_queries

    plan = file_queries.cut_images(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan

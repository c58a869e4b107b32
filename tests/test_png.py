import struct
import zlib

import numpy as np
import pytest

from latticework.kernels import png


def build(width, height, depth, color, raw, extra=(), interlace=0):
    head = struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, interlace)
    body = png.SIGNATURE + png._chunk(b"IHDR", head)
    for kind, data in extra:
        body += png._chunk(kind, data)
    return body + png._chunk(b"IDAT", zlib.compress(raw)) + png._chunk(b"IEND", b"")


def test_round_trip():
    rgba = np.random.default_rng(1).integers(0, 256, (7, 5, 4)).astype(np.uint8)
    data = png.encode(rgba)
    back, alpha = png.decode(data)
    assert alpha and (back == rgba).all() and png.encode(rgba) == data


@pytest.mark.parametrize("kind", range(5))
def test_filters(kind):
    rgba = np.random.default_rng(kind).integers(0, 256, (6, 9, 4)).astype(np.uint8)
    flat = rgba.reshape(6, 36).astype(int)
    raw = b""
    for y in range(6):
        line = bytearray([kind])
        for i in range(36):
            a = flat[y, i - 4] if i >= 4 else 0
            b = flat[y - 1, i] if y else 0
            c = flat[y - 1, i - 4] if y and i >= 4 else 0
            p = a + b - c
            near = min((abs(p - v), n) for n, v in enumerate((a, b, c)))[1]
            guess = (0, a, b, (a + b) // 2, (a, b, c)[near])[kind]
            line.append((flat[y, i] - guess) & 255)
        raw += bytes(line)
    assert (png.decode(build(9, 6, 8, 6, raw))[0] == rgba).all()


def test_palette_grey_and_depths():
    palette = bytes([255, 0, 0, 0, 255, 0])
    two = build(3, 1, 1, 3, bytes([0, 0b01000000]), [(b"PLTE", palette), (b"tRNS", bytes([255, 0]))])
    rgba, alpha = png.decode(two)
    assert alpha and rgba[0].tolist() == [[255, 0, 0, 255], [0, 255, 0, 0], [255, 0, 0, 255]]
    assert png.header(two)["has_alpha"]
    grey, alpha = png.decode(build(2, 1, 4, 0, bytes([0, 0x0F])))
    assert not alpha and grey[0].tolist() == [[0, 0, 0, 255], [255, 255, 255, 255]]
    wide, alpha = png.decode(build(1, 1, 16, 4, bytes([0, 0x12, 0x34, 0x80, 0])))
    assert alpha and wide[0, 0].tolist() == [0x12, 0x12, 0x12, 0x80]


def test_interlaced():
    rgba = np.random.default_rng(3).integers(0, 256, (5, 6, 4)).astype(np.uint8)
    raw = b""
    for x0, y0, dx, dy in png._ADAM7:
        part = rgba[y0::dy, x0::dx]
        if part.size:
            raw += b"".join(b"\0" + line.tobytes() for line in part)
    assert (png.decode(build(6, 5, 8, 6, raw, interlace=1))[0] == rgba).all()


@pytest.mark.parametrize("data", [b"", b"no png", png.SIGNATURE, png.encode(np.zeros((2, 2, 4), np.uint8))[:-20]])
def test_bad_files(data):
    with pytest.raises(png.PngError):
        png.decode(data)

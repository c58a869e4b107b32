"""PNG files to RGBA arrays and back, with zlib and numpy only. All colour types, depths and Adam7."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


class PngError(ValueError):
    pass


def chunks(data: bytes):
    """(type, body) of each chunk up to IEND."""
    if data[:8] != SIGNATURE:
        raise PngError("not a PNG file")
    at = 8
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise PngError("chunk is cut off")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise PngError("no end chunk")


def header(data: bytes) -> dict:
    """width, height, bit_depth, color_type, has_alpha; pixel data is not read."""
    if len(data) < 33 or data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise PngError("no PNG header")
    width, height, depth, color = struct.unpack(">IIBB", data[16:26])
    alpha = color in (4, 6) or (color == 3 and any(kind == b"tRNS" for kind, _ in chunks(data)))
    return {"width": width, "height": height, "bit_depth": depth, "color_type": color, "has_alpha": alpha}


def _unfilter(raw: bytes, rows: int, stride: int, step: int) -> np.ndarray:
    if len(raw) < rows * (stride + 1):
        raise PngError("pixel data is cut off")
    lines = np.frombuffer(raw, np.uint8, rows * (stride + 1)).reshape(rows, stride + 1)
    out = np.zeros((rows + 1, stride), np.uint8)
    for y in range(rows):
        kind, line, up = int(lines[y, 0]), lines[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 2:
            out[y + 1] = line + up
        elif kind == 1:
            # sums along each byte lane, modulo 256
            lanes = -(-stride // step)
            padded = np.zeros(lanes * step, np.uint8)
            padded[:stride] = line
            out[y + 1] = np.cumsum(padded.reshape(lanes, step), axis=0, dtype=np.uint64).astype(np.uint8).reshape(-1)[:stride]
        elif kind in (3, 4):
            now, above = bytearray(line.tobytes()), up.tobytes()
            for i in range(stride):
                a = now[i - step] if i >= step else 0
                if kind == 3:
                    now[i] = (now[i] + (a + above[i]) // 2) & 255
                else:
                    b, c = above[i], above[i - step] if i >= step else 0
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    now[i] = (now[i] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
            out[y + 1] = np.frombuffer(bytes(now), np.uint8)
        else:
            raise PngError("unknown filter")
    return out[1:]


def _samples(lines: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """(rows, width, channels) samples as stored."""
    rows = len(lines)
    if depth == 8:
        flat = lines
    elif depth == 16:
        flat = lines.reshape(rows, -1, 2).astype(np.uint16)
        flat = (flat[:, :, 0] << 8) | flat[:, :, 1]
    else:
        bits = np.unpackbits(lines, axis=1).reshape(rows, -1, depth)
        flat = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2)
    return flat[:, : width * channels].reshape(rows, width, channels)


def decode(data: bytes) -> tuple[np.ndarray, bool]:
    """(RGBA array of shape (height, width, 4), has_alpha)."""
    try:
        info = header(data)
        width, height, depth, color = (info[k] for k in ("width", "height", "bit_depth", "color_type"))
        if color not in _CHANNELS or not width or not height or depth not in (1, 2, 4, 8, 16):
            raise PngError("unknown colour type, depth or size")
        parts = list(chunks(data))
        raw = zlib.decompress(b"".join(b for k, b in parts if k == b"IDAT"))
    except (zlib.error, struct.error) as e:
        raise PngError(str(e)) from e
    interlaced = data[28] == 1
    n = _CHANNELS[color]
    step = max(1, n * depth // 8)
    out = np.zeros((height, width, n), np.uint16)
    at = 0
    for x0, y0, dx, dy in _ADAM7 if interlaced else ((0, 0, 1, 1),):
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        stride = -(-w * n * depth // 8)
        lines = _unfilter(raw[at:], h, stride, step)
        at += h * (stride + 1)
        out[y0::dy, x0::dx] = _samples(lines, w, n, depth)
    transparent = next((b for k, b in parts if k == b"tRNS"), None)
    rgba = np.full((height, width, 4), 255, np.uint8)
    if color == 3:
        palette = next((b for k, b in parts if k == b"PLTE"), None)
        if palette is None:
            raise PngError("no palette")
        table = np.full((256, 4), 255, np.uint8)
        table[: len(palette) // 3, :3] = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        if transparent:
            table[: len(transparent), 3] = np.frombuffer(transparent, np.uint8)
        return table[out[:, :, 0] & 255], transparent is not None
    scaled = (out >> 8 if depth == 16 else out * (255 // ((1 << depth) - 1))).astype(np.uint8)
    rgba[:, :, :3] = scaled[:, :, :3] if n >= 3 else scaled[:, :, :1]
    if n in (2, 4):
        rgba[:, :, 3] = scaled[:, :, -1]
    elif transparent:
        key = np.frombuffer(transparent, ">u2")
        rgba[:, :, 3] = np.where((out == key[:n]).all(2), 0, 255)
    return rgba, info["has_alpha"]


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(rgba: np.ndarray, level: int = 6) -> bytes:
    """An 8-bit RGBA file; the same array always gives the same bytes."""
    height, width = rgba.shape[:2]
    lines = np.zeros((height, width * 4 + 1), np.uint8)
    lines[:, 1:] = np.ascontiguousarray(rgba, np.uint8).reshape(height, -1)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")

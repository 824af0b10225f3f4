"""PNG images as arrays and back, with the standard library and numpy; interlaced images and those of 16 bits a channel raise."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type (grey, RGB, palette, grey with alpha, RGBA).
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode(data: bytes) -> np.ndarray:
    """height x width x 3, RGB; alpha is left out."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, packed, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
    if head is None or head[3] not in CHANNELS or head[2] > 8 or head[6]:
        raise ValueError("an image of a kind that is not read")
    width, height, bits, colour = head[:4]
    bpp = max(1, CHANNELS[colour] * bits // 8)
    line = -(-width * CHANNELS[colour] * bits // 8)
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, line + 1)
    out, above = np.zeros((height, line), np.uint8), np.zeros(line, np.uint8)
    for y in range(height):
        above = out[y] = unfiltered(int(raw[y, 0]), raw[y, 1:], above, bpp)
    if bits < 8:
        out = (np.unpackbits(out, axis=1)[:, : line * 8 // bits * bits].reshape(height, -1, bits) @ (1 << np.arange(bits)[::-1])).astype(np.uint8)[:, :width]
        out = out if colour == 3 else out * (255 // ((1 << bits) - 1))
    out = out.reshape(height, width, -1)
    if colour == 3:
        return palette[out[:, :, 0]]
    return out[:, :, :3].copy() if colour in (2, 6) else np.repeat(out[:, :, :1], 3, axis=2)


def unfiltered(kind: int, x: np.ndarray, above: np.ndarray, bpp: int) -> np.ndarray:
    if kind == 0:
        return x
    if kind == 2:
        return x + above
    if kind == 1:
        pad = -len(x) % bpp
        return np.cumsum(np.pad(x, (0, pad)).reshape(-1, bpp), axis=0, dtype=np.uint8).ravel()[: len(x)]
    out, up = [0] * bpp + x.tolist(), [0] * bpp + above.tolist()
    for i in range(bpp, len(out)):
        a, b, c = out[i - bpp], up[i], up[i - bpp]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i] = (out[i] + guess) & 255
    return np.array(out[bpp:], np.uint8)


def encode(pixels: np.ndarray) -> bytes:
    """An RGB image."""
    height, width, _ = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1).tobytes()
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def painted(pixels: np.ndarray, boxes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """pixels with the boxes (left, top, width, height) black, as far as they are inside the image."""
    out = pixels.copy()
    for left, top, width, height in boxes:
        out[max(0, top) : max(0, top + height), max(0, left) : max(0, left + width)] = 0
    return out

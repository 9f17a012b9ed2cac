"""Lossless pictures: decoding to RGBA, and PNG files."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def lossless(body: bytes, alpha: bool) -> np.ndarray:
    """RGBA pixels (height, width, 4) of a lossless picture's tag body; premultiplied colours are divided out again."""
    kind, width, height = body[2], *struct.unpack_from("<HH", body, 3)
    if kind == 3:
        colours = body[7] + 1
        raw = zlib.decompress(body[8:])
        size = 4 if alpha else 3
        table = np.frombuffer(raw, np.uint8, colours * size).reshape(colours, size)
        stride = (width + 3) // 4 * 4
        index = np.frombuffer(raw, np.uint8, stride * height, colours * size).reshape(height, stride)[:, :width]
        pixels = np.zeros((256, 4), np.uint8)
        pixels[:colours, :size] = table
        if not alpha:
            pixels[:, 3] = 255
        out = pixels[index]
    elif kind == 4:
        raw = zlib.decompress(body[7:])
        stride = (width * 2 + 3) // 4 * 4
        x = np.frombuffer(raw, np.uint8, stride * height).reshape(height, stride)[:, : width * 2].reshape(height, width, 2).astype(np.uint16)
        v = x[..., 0] << 8 | x[..., 1]
        five = np.stack((v >> 10 & 31, v >> 5 & 31, v & 31), axis=-1)
        out = np.concatenate(((five * 255 // 31).astype(np.uint8), np.full((height, width, 1), 255, np.uint8)), axis=-1)
    else:
        raw = zlib.decompress(body[7:])
        x = np.frombuffer(raw, np.uint8, width * height * 4).reshape(height, width, 4)
        out = np.stack((x[..., 1], x[..., 2], x[..., 3], x[..., 0] if alpha else np.full((height, width), 255, np.uint8)), axis=-1)
    if alpha:
        a = out[..., 3:].astype(np.uint16)
        colour = np.where(a > 0, np.minimum(255, (out[..., :3].astype(np.uint16) * 255 + a // 2) // np.maximum(a, 1)), 0)
        out = np.concatenate((colour.astype(np.uint8), out[..., 3:]), axis=-1)
    return out


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of RGBA pixels."""
    height, width = pixels.shape[:2]

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    rows = np.concatenate((np.zeros((height, 1), np.uint8), pixels.reshape(height, width * 4)), axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 9)) + chunk(b"IEND", b"")

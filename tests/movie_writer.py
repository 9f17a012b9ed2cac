"""Writes containers for tests, from the format's layout."""

import lzma
import struct
import zlib


class Bits:
    def __init__(self):
        self.text = ""

    def u(self, value, n):
        self.text += format(value & ((1 << n) - 1), f"0{n}b") if n else ""
        return self

    def done(self):
        padded = self.text + "0" * (-len(self.text) % 8)
        return bytes(int(padded[i : i + 8], 2) for i in range(0, len(padded), 8))


def rect(x0, x1, y0, y1, n=None):
    n = n or max(max(abs(v).bit_length() + 1 for v in (x0, x1, y0, y1)), 1)
    b = Bits().u(n, 5)
    for v in (x0, x1, y0, y1):
        b.u(v, n)
    return b.done()


def matrix(tx=0, ty=0, scale=None):
    b = Bits()
    if scale:
        raw = int(scale * 65536)
        n = raw.bit_length() + 1
        b.u(1, 1).u(n, 5).u(raw, n).u(raw, n)
    else:
        b.u(0, 1)
    n = max(abs(tx).bit_length(), abs(ty).bit_length()) + 1 if tx or ty else 0
    return b.u(0, 1).u(n, 5).u(tx, n).u(ty, n).done()


def tag(code, body=b"", long=False):
    if len(body) >= 63 or long:
        return struct.pack("<HI", code << 6 | 63, len(body)) + body
    return struct.pack("<H", code << 6 | len(body)) + body


END, SHOW = tag(0), tag(1)


def place(depth, character=None, name=None, at=(0, 0), move=False, clip=None):
    flags = move | (character is not None) << 1 | 4 | (name is not None) << 5 | (clip is not None) << 6
    body = struct.pack("<BH", flags, depth)
    if character is not None:
        body += struct.pack("<H", character)
    body += matrix(*at)
    if name is not None:
        body += name.encode() + b"\0"
    if clip is not None:
        body += struct.pack("<H", clip)
    return tag(26, body)


def remove(depth):
    return tag(28, struct.pack("<H", depth))


def square(character, size=2000):
    n = 16
    b = Bits().u(0, 4).u(1, 4).u(0, 1).u(0b01001, 5).u(n, 5).u(0, n).u(0, n).u(1, 1)
    for vertical, d in ((0, size), (1, size), (0, -size), (1, -size)):
        b.u(1, 1).u(1, 1).u(n - 2, 4).u(0, 1).u(vertical, 1).u(d, n)
    styles = b"\0" + b"\1" + struct.pack("<H", 20) + b"\0\0\0"
    return tag(2, struct.pack("<H", character) + rect(0, size, 0, size) + styles + b.u(0, 6).done())


def sprite(character, frames, inner):
    return tag(39, struct.pack("<HH", character, frames) + inner)


def movie(tags, version=6, frames=1, kind="none", rate=3072, length=None, size=(11000, 8000)):
    body = rect(0, size[0], 0, size[1]) + struct.pack("<HH", rate, frames) + tags
    head = {"none": b"FWS", "zlib": b"CWS", "lzma": b"ZWS"}[kind] + bytes([version]) + struct.pack("<I", len(body) + 8 if length is None else length)
    if kind == "zlib":
        return head + zlib.compress(body)
    if kind == "lzma":
        packed = lzma.compress(body, lzma.FORMAT_ALONE)
        return head + struct.pack("<I", len(packed) - 13) + packed[:5] + packed[13:]
    return head + body


#: The 79-byte example that is printed in the format's specification: one outlined rectangle.
EXAMPLE = bytes.fromhex(
    "4657 5303 4f00 0000 7800 055f 0000 0fa0 0000 0c01 0043 02ff ffff bf00 2300 0000 0100 70fb 4997 0d0c 7d50 0001"
    "1400 0000 0001 25c9 920d 21ed 4887 6530 3b6d e1d8 b400 0086 0606 0100 0100 0040 0000 00"
)

"""Reading little-endian fields and most-significant-first bit fields from bytes."""

from __future__ import annotations

import struct


class PastEnd(Exception):
    """A field reaches beyond the bytes there are."""


#: Bytes 0x80 to 0x9f of windows-1252, where the five codes without a character keep their control character. Fixed values.
_C1 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def legacy_text(raw: bytes) -> str:
    """Text of files before version 6, read as windows-1252."""
    return "".join(_C1[b - 0x80] if 0x80 <= b < 0xA0 else chr(b) for b in raw)


class Reader:
    """A position in `data[start:end]`. Bit fields start at the next bit; every other field starts at a whole byte."""

    def __init__(self, data: bytes, start: int = 0, end: int | None = None, version: int = 6):
        self.data, self.at, self.end, self.version = data, start, len(data) if end is None else end, version
        self.bit = 0
        self.notes: list[str] = []

    def align(self) -> None:
        if self.bit:
            self.at, self.bit = self.at + 1, 0

    def left(self) -> int:
        return max(0, self.end - self.at - (self.bit > 0))

    def take(self, n: int) -> bytes:
        self.align()
        if n < 0 or self.at + n > self.end:
            raise PastEnd
        self.at += n
        return self.data[self.at - n : self.at]

    def _number(self, n: int, signed: bool = False) -> int:
        return int.from_bytes(self.take(n), "little", signed=signed)

    def u8(self) -> int:
        return self._number(1)

    def u16(self) -> int:
        return self._number(2)

    def u24(self) -> int:
        return self._number(3)

    def u32(self) -> int:
        return self._number(4)

    def u64(self) -> int:
        return self._number(8)

    def s8(self) -> int:
        return self._number(1, True)

    def s16(self) -> int:
        return self._number(2, True)

    def s32(self) -> int:
        return self._number(4, True)

    def f32(self) -> float:
        return struct.unpack("<f", self.take(4))[0]

    def f64(self) -> float:
        return struct.unpack("<d", self.take(8))[0]

    def f64_swapped(self) -> float:
        """A double whose 32-bit halves are stored high half first, as pushed numbers are."""
        raw = self.take(8)
        return struct.unpack("<d", raw[4:] + raw[:4])[0]

    def f16(self) -> float:
        """Half precision (binary16)."""
        raw = self.u16()
        sign, exponent, fraction = -1.0 if raw & 0x8000 else 1.0, raw >> 10 & 31, raw & 1023
        if exponent == 31:
            self.notes.append("special half float")
            return float("nan") if fraction else sign * float("inf")
        return sign * (fraction * 2.0**-24 if exponent == 0 else (1 + fraction / 1024) * 2.0 ** (exponent - 15))

    def fixed(self) -> float:
        return self.s32() / 65536

    def fixed8(self) -> float:
        return self.s16() / 256

    def encoded_u32(self) -> int:
        """Seven bits a byte, five bytes at most; noted if it takes more bytes than needed."""
        value = 0
        for k in range(5):
            byte = self.u8()
            value |= (byte & 127) << 7 * k
            if byte < 128:
                if k and byte == 0:
                    self.notes.append("overlong number")
                break
        return value & 0xFFFFFFFF

    def ub(self, n: int) -> int:
        value = 0
        while n:
            if self.at >= self.end:
                raise PastEnd
            here = min(n, 8 - self.bit)
            chunk = self.data[self.at] >> (8 - self.bit - here) & ((1 << here) - 1)
            value, n, self.bit = value << here | chunk, n - here, self.bit + here
            if self.bit == 8:
                self.at, self.bit = self.at + 1, 0
        return value

    def sb(self, n: int) -> int:
        value = self.ub(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def fb(self, n: int) -> float:
        return self.sb(n) / 65536

    def flag(self) -> bool:
        return bool(self.ub(1))

    def string(self) -> str:
        """A string up to a zero byte: UTF-8 from version 6 on, before that windows-1252; cut at the end if unterminated."""
        self.align()
        stop = self.data.find(b"\0", self.at, self.end)
        if stop < 0:
            self.notes.append("unterminated string")
            raw, self.at = self.data[self.at : self.end], self.end
        else:
            raw, self.at = self.data[self.at : stop], stop + 1
        return self.text(raw)

    def text(self, raw: bytes) -> str:
        if self.version < 6:
            return legacy_text(raw)
        try:
            return raw.decode()
        except UnicodeDecodeError:
            self.notes.append("invalid utf-8")
            return raw.decode("utf-8", "replace")

    def rect(self) -> dict:
        self.align()
        n = self.ub(5)
        x0, x1, y0, y1 = (self.sb(n) for _ in range(4))
        self.align()
        return {"xMin": x0, "xMax": x1, "yMin": y0, "yMax": y1}

    def matrix(self) -> dict:
        """Scale and rotation as numbers, translation in twips."""
        self.align()
        a = d = 1.0
        b = c = 0.0
        if self.flag():
            n = self.ub(5)
            a, d = self.fb(n), self.fb(n)
        if self.flag():
            n = self.ub(5)
            b, c = self.fb(n), self.fb(n)
        n = self.ub(5)
        tx, ty = self.sb(n), self.sb(n)
        self.align()
        return {"a": a, "b": b, "c": c, "d": d, "tx": tx, "ty": ty}

    def colour_transform(self, alpha: bool) -> dict:
        """Factors (256 is one) and offsets for each channel."""
        self.align()
        has_add, has_mult = self.flag(), self.flag()
        n = self.ub(4)
        channels = "rgba" if alpha else "rgb"
        out = {f"{c}Mult": 256 for c in "rgba"} | {f"{c}Add": 0 for c in "rgba"}
        for there, what in ((has_mult, "Mult"), (has_add, "Add")):
            if there:
                out |= {f"{c}{what}": self.sb(n) for c in channels}
        self.align()
        return out

    def rgb(self) -> list[int]:
        return [*self.take(3), 255]

    def rgba(self) -> list[int]:
        return list(self.take(4))

    def argb(self) -> list[int]:
        a, r, g, b = self.take(4)
        return [r, g, b, a]

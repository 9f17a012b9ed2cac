"""Hashes over byte arrays: rolling ones that pick places, and those of content that tell texts apart."""

from __future__ import annotations

import hashlib

import numpy as np

_ODD = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit numbers (shift, multiply, shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def byte_table(seed: int) -> np.ndarray:
    """256 pseudo-random 64-bit numbers, one for each byte value."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD) + np.uint64(seed))


_TABLE = byte_table(0x5EED)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Key of the digests on which texts are cut: none can be built to collide without it.
DIGEST_KEY = b"sparkloom digest"


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the odd base, and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        base = 0xF1357AEA2E62A9C5
        for k, b in enumerate((base, pow(base, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


class Fingerprints:
    """Constant-time rolling hashes of any substring of a byte array, to pick places by; never to tell texts apart.

    The hash of bytes[i:j] is the sum of table[byte] * base**(k - i), modulo 2**64, then scrambled: it depends on the
    content alone, not on the place. A polynomial modulo a power of two has collisions whatever its table and base are
    (Thue-Morse words), so equality of content is decided by `content_hashes` and `digests` instead.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[:n], out=self.sums[1:], dtype=np.uint64)

    def rolling(self, width: int) -> np.ndarray:
        """The hashes of all substrings of `width` bytes."""
        n = len(self.sums) - width
        return mix64((self.sums[width:] - self.sums[:n]) * self.down[:n] + np.uint64(width))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def content_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0, longest: int = 256) -> np.ndarray:
    """64-bit hashes of the substrings [start, end) of a byte array, by their content alone.

    A chain over 8 bytes at a time, each scrambled by a bijection that is not linear over the state: strings of
    one length up to 8 never collide, others as random numbers do. Strings over `longest` bytes enter by their digest.
    """
    size = end - start
    state = mix64((size.astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD) + np.uint64(seed))
    if not len(size):
        return state
    words = np.concatenate((data, np.zeros(8, np.uint8)))
    at = np.flatnonzero(size <= longest)
    for step in range(0, int(size[at].max(initial=0)), 8):
        at = at[size[at] > step]
        first = start[at] + step
        load = np.lib.stride_tricks.sliding_window_view(words, 8)[first].view(np.uint64)[:, 0]
        left = np.minimum(size[at] - step, 8).astype(np.uint64)
        load = load & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        state[at] = mix64(state[at] ^ mix64(load + np.uint64(0xA0761D6478BD642F)))
    far = np.flatnonzero(size > longest)
    if len(far):
        state[far] = mix64(digests(data, start[far], end[far])[:, 0] ^ np.uint64(seed))
    return state


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Keyed 128-bit BLAKE2 digests of the substrings [start, end), as two 64-bit numbers each."""
    view, blake = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    out = [blake(view[a:b], digest_size=16, key=DIGEST_KEY).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    return np.frombuffer(b"".join(out), np.uint64).reshape(-1, 2)

"""Word positions, word hashes and word shingles of UTF-8 byte blocks, vectorised."""

from __future__ import annotations

import numpy as np

from sparkloom.llm.common import BLOCK_BYTES
from sparkloom.llm.hashing import content_hashes, mix64

#: Words are runs of bytes other than the space and the five control characters 9 to 13.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A-Z become a-z, all other bytes stay.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words of each row; words never cross rows."""
    n = len(data)
    rows = len(offsets) - 1
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(rows, np.int64)
    word = ~_SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    start[inner] = word[inner]
    end = word.copy()
    end[:-1] &= ~word[1:]
    end[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(start)
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, np.flatnonzero(end) + 1, counts


def _word_hashes(data: np.ndarray, offsets: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, with A-Z lower-cased, and the number of words of each row.

    A single text longer than `piece` is cut at blanks, as far as it has any.
    """
    if len(offsets) == 2 and len(data) > piece:
        parts, total, at = [], 0, 0
        while at < len(data):
            end = min(len(data), at + piece)
            if end < len(data):
                blank = np.flatnonzero(_SPACE[data[at:end]])
                after = np.flatnonzero(_SPACE[data[end:]]) if not len(blank) else blank
                end = at + int(blank[-1]) + 1 if len(blank) else end + int(after[0]) + 1 if len(after) else len(data)
            words, count = _word_hashes(data[at:end], np.array([0, end - at]), len(data))
            parts.append(words)
            total += int(count[0])
            at = end
        return np.concatenate(parts), np.array([total])
    starts, ends, counts = word_spans(data, offsets)
    return content_hashes(_LOWER[data], starts, ends), counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int, piece: int = 4 * BLOCK_BYTES) -> list[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its shingles of `size` words, with A-Z lower-cased.

    A row with fewer words has one shingle, its whole sequence; a row without words has none.
    """
    word, counts = _word_hashes(data, offsets, piece)
    if not len(word):
        return [np.zeros(0, np.uint64)] * (len(offsets) - 1)
    factor = mix64(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    total = len(word) - size + 1
    if total > 0:
        grams = np.zeros(total, np.uint64)
        for k in range(size):
            grams += word[k : k + total] * factor[k]
        grams = mix64(grams)
    out, at = [], 0
    for count in counts.tolist():
        if count >= size:
            x = np.sort(grams[at : at + count - size + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif count:
            short = (word[at : at + count] * factor[:count]).sum(dtype=np.uint64) + np.uint64(count)
            out.append(mix64(np.array([short], np.uint64) + np.uint64(0xABCDEF)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out

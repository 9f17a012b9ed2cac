"""SentencePiece encoding and decoding by suffix-array matching.

Texts fall apart at blanks, which no piece crosses, so equal words are encoded once. The words of a batch that were not
seen before are concatenated and indexed by a suffix array; every piece of the vocabulary is found by binary search, all
pieces at once, and its range in the array holds all of its occurrences. The occurrences, sorted by position, are the
edges of a lattice, which is then relaxed: for a unigram model along positions (best score up to each), for a BPE model
in the order of merge priority (an edge that joins two symbols and scores best goes first), as such a model defines its
encoding by merges and not by the best sum.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import free_memory, prepare

#: The model's path is a parameter everywhere; this is the default.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "\u2581"
#: Words kept in a task's memory, code points indexed at once, and longest word that is relaxed in step with others.
CACHE, INDEX_CHARS, LONG = 300_000, 500_000, 48
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6


@dataclass(frozen=True)
class Model:
    """What encoding needs of a SentencePiece model; kinds are those of the file format."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    unigram: bool = False
    dummy_prefix: bool = True

    @property
    def unknown(self) -> int:
        return self.kinds.index(_UNKNOWN) if _UNKNOWN in self.kinds else 0

    @property
    def byte_ids(self) -> dict[int, int]:
        return {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == _BYTE}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


def load_model(path: str = MODEL) -> Model:
    """Reads a model file. Models that normalise texts, drop blanks or hold user-defined pieces are refused."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, kinds, unigram, prefix = [], [], [], True, True
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append(own.get(1, b"").decode())
            scores.append(float(np.frombuffer(own.get(2, bytes(4)), np.float32)[0]))
            kinds.append(own.get(3, _NORMAL))
        elif number == 2:
            kind = dict(_fields(value)).get(3, _UNIGRAM)
            if kind not in (_UNIGRAM, _BPE):
                raise ValueError("only unigram and BPE models are known")
            unigram = kind == _UNIGRAM
        elif number == 3:
            own = dict(_fields(value))
            if own.get(2, b"") or own.get(4, 1) or not own.get(5, 1):
                raise ValueError("the model changes texts before encoding")
            prefix = bool(own.get(3, 1))
    if 4 in kinds or any(BLANK in p.lstrip(BLANK) for p, k in zip(pieces, kinds, strict=True) if k == _NORMAL):
        raise ValueError("pieces that cross blanks, or that users defined, are not known")
    return Model(tuple(pieces), tuple(scores), tuple(kinds), unigram, prefix)


class Encoder:
    """Encodes and decodes with one model; keeps what it learned about words."""

    def __init__(self, model: Model):
        self.model = model
        ids = [i for i, k in enumerate(model.kinds) if k == _NORMAL and model.pieces[i]]
        self.longest = max((len(model.pieces[i]) for i in ids), default=1)
        self.words3 = -(-self.longest // 3)
        order = sorted(set(model.scores[i] for i in ids), reverse=True)
        rank = {s: r for r, s in enumerate(order)}
        self.piece_id = np.array(ids, np.int64)
        self.piece_len = np.array([len(model.pieces[i]) for i in ids], np.int64)
        self.rank_of = np.full(len(model.pieces) + 1, 1 << 30, np.int64)
        for i in ids:
            self.rank_of[i] = rank[model.scores[i]]
        self.score_of = np.array([*model.scores, -np.inf])
        codes = np.zeros((len(ids), 3 * self.words3), np.uint64)
        for r, i in enumerate(ids):
            codes[r, : len(model.pieces[i])] = [ord(c) for c in model.pieces[i]]
        self.low = self._packed(codes)
        codes[np.arange(codes.shape[1]) >= self.piece_len[:, None]] = (1 << 21) - 1
        self.high = self._packed(codes)
        self.bytes_of = model.byte_ids
        self.raw = [b"" if k not in (_NORMAL, _BYTE, _UNKNOWN) else bytes([int(p[3:5], 16)]) if k == _BYTE else " \u2047 ".encode() if k == _UNKNOWN else p.replace(BLANK, " ").encode() for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.known: dict[str, bytes] = {}  # ids as 32-bit numbers, end to end
        self.split = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")

    @staticmethod
    def _packed(codes: np.ndarray) -> np.ndarray:
        return codes[:, 0::3] << np.uint64(42) | codes[:, 1::3] << np.uint64(21) | codes[:, 2::3]

    def lattice(self, codes: np.ndarray) -> np.ndarray:
        """Piece ids by position and length, -1 where none; the suffix array of `codes` is sorted as far as pieces reach."""
        n = len(codes)
        padded = np.concatenate((codes.astype(np.uint64), np.full(3 * self.words3 + 3, (1 << 21) - 1, np.uint64)))
        key = padded[:-2] << np.uint64(42) | padded[1:-1] << np.uint64(21) | padded[2:]
        order = np.argsort(key[:n])
        rank = self._dense(key[:n], order)
        have = 3
        while have < self.longest:
            step = min(have, self.longest - have)
            far = np.full(n, n, np.uint64)
            if step < n:
                far[: n - step] = rank[step:]
            both = rank * np.uint64(n + 1) + far
            order = np.argsort(both)
            rank = self._dense(both, order)
            have += step
        first, last = self._bounds(key, order, self.low, False), self._bounds(key, order, self.high, True)
        count = np.maximum(last - first, 0)
        # Occurrences of all pieces, laid out by position and length.
        piece = np.repeat(np.arange(len(count)), count)
        at = order[np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)]
        table = np.full((n + 1, self.longest + 1), -1, np.int32)
        table[at, self.piece_len[piece]] = self.piece_id[piece]
        return table

    @staticmethod
    def _dense(key: np.ndarray, order: np.ndarray) -> np.ndarray:
        by = key[order]
        rank = np.empty(len(key), np.uint64)
        rank[order] = np.cumsum(np.concatenate(([0], by[1:] != by[:-1]))).astype(np.uint64)
        return rank

    def _bounds(self, key: np.ndarray, order: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
        """For each row of `wanted`, the first place in the suffix array whose suffix is not below (`after`: above) it."""
        head = key[order]  # the first three characters decide on short pieces and narrow the search for others
        bounds = np.searchsorted(head, wanted[:, 0], "right" if after else "left")
        longer = np.flatnonzero(self.piece_len > 3)
        low, high = np.searchsorted(head, wanted[longer, 0], "left"), np.searchsorted(head, wanted[longer, 0], "right")
        while len(longer):
            open_ = low < high
            bounds[longer[~open_]] = low[~open_]
            longer, low, high = longer[open_], low[open_], high[open_]
            mid = (low + high) // 2
            at, want = order[mid], wanted[longer]
            below, same = np.zeros(len(longer), bool), np.ones(len(longer), bool)
            for w in range(1, self.words3):
                k = key[np.minimum(at + 3 * w, len(key) - 1)]
                below |= same & (k < want[:, w])
                same &= k == want[:, w]
            if after:
                below |= same
            low, high = np.where(below, mid + 1, low), np.where(below, high, mid)
        return bounds

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        out, part, size = {}, [], 0
        for w in words:
            part.append(w)
            size += len(w) + 1
            if size > INDEX_CHARS:
                out |= self._encode_words(part)
                part, size = [], 0
        return out | self._encode_words(part)

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        if not words:
            return {}
        lengths = np.array([len(w) for w in words])
        # One code that no piece holds stands between words.
        joined = np.frombuffer("\0".join(words).encode("utf-32-le"), np.uint32).copy()
        starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        joined[starts[1:] - 1] = (1 << 21) - 1
        table = self.lattice(joined)
        if self.model.unigram:
            ends = self._best_paths(table, starts, lengths)
        else:
            ends = self._merges(table, starts, lengths)
        # Symbols of all words in a row: word, end, and from them start and piece.
        word, end = ends
        first = np.concatenate(([True], word[1:] != word[:-1]))
        begin = np.where(first, starts[word], np.concatenate(([0], end[:-1])))
        size = end - begin
        piece = np.where(size <= self.longest, table[begin, np.minimum(size, self.longest)], -1)
        at = np.concatenate((np.flatnonzero(first), [len(word)])).tolist()
        ids = piece.astype("<i4").tobytes()
        out = {w: ids[4 * a : 4 * b] for w, a, b in zip(words, at[:-1], at[1:], strict=True)}
        for k in set(word[piece < 0].tolist()):
            w, start, found = words[k], int(starts[k]), []
            own = slice(at[k], at[k + 1])
            for i, a, b in zip(piece[own].tolist(), begin[own].tolist(), end[own].tolist(), strict=True):
                if i >= 0:
                    found.append(i)
                elif self.bytes_of:
                    found += [self.bytes_of[x] for x in w[a - start : b - start].encode()]
                elif not (found and found[-1] == self.model.unknown):
                    found.append(self.model.unknown)
            out[w] = np.array(found, "<i4").tobytes()
        return out

    def _merges(self, table: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and ends of all symbols after all merges, best score first, leftmost among equals."""
        done_words, done_ends = [], []
        for w in np.flatnonzero(lengths > LONG).tolist():
            done_ends.append(np.array(self._merge_one(table, int(starts[w]), int(lengths[w]))))
            done_words.append(np.full(len(done_ends[-1]), w))
        word = np.flatnonzero(lengths <= LONG)
        begin = starts[word]
        word = np.repeat(word, lengths[word])
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.zeros(0, int)
        offset = np.arange(len(word)) - np.repeat(first, np.diff(np.concatenate((first, [len(word)]))))
        pos = np.repeat(begin, lengths[lengths <= LONG]) + offset
        size = np.ones(len(pos), np.int64)
        none = np.int64(1) << 62
        while len(word):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            both = size[:-1] + size[1:]
            fits = (word[1:] == word[:-1]) & (both <= self.longest)
            key = np.full(len(word), none)
            at = np.flatnonzero(fits)
            piece = table[pos[at], both[at]]
            at, piece = at[piece >= 0], piece[piece >= 0]
            key[at] = self.rank_of[piece] << 32 | at
            best = np.minimum.reduceat(key, first)
            done = best == none
            keep = np.repeat(~done, np.diff(np.concatenate((first, [len(word)]))))
            if done.any():
                done_words.append(word[~keep])
                done_ends.append((pos + size)[~keep])
            i = best[~done] & 0xFFFFFFFF
            size[i] += size[i + 1]
            keep[i + 1] = False
            word, pos, size = word[keep], pos[keep], size[keep]
        word, end = np.concatenate(done_words), np.concatenate(done_ends)
        order = np.argsort(end, kind="stable")  # words lie one after the other
        return word[order], end[order]

    def _merge_one(self, table: np.ndarray, start: int, length: int) -> list[int]:
        """The same for one long word, with a heap."""
        end = list(range(1, length + 1))  # end of the symbol that starts here; 0 once merged into another
        before = list(range(-1, length - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(a: int) -> None:
            b = end[a]
            if b < length and end[b] - a <= self.longest:
                piece = int(table[start + a, end[b] - a])
                if piece >= 0:
                    heapq.heappush(heap, (int(self.rank_of[piece]), a, end[b]))

        for a in range(length):
            offer(a)
        while heap:
            _, a, stop = heapq.heappop(heap)
            b = end[a]
            if not b or b >= length or end[b] != stop:
                continue
            end[a], end[b] = stop, 0
            if stop < length:
                before[stop] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        out, a = [], 0
        while a < length:
            a = end[a]
            out.append(start + a)
        return out

    def _best_paths(self, table: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and ends of all symbols on the best paths; unknown characters score 10 below the worst piece."""
        worst = float(self.score_of[self.piece_id].min()) - 10
        best = np.full(len(table), -np.inf)
        back = np.zeros(len(table), np.int64)
        best[starts] = 0
        for p in range(1, int(lengths.max(initial=0)) + 1):
            here = starts[lengths >= p] + p
            # The first position of a word shares no cell with the word before it: one separator lies between.
            score, step = np.full(len(here), -np.inf), np.ones(len(here), np.int64)
            for size in range(1, min(self.longest, p) + 1):
                piece = table[here - size, size]
                edge = np.where(piece >= 0, self.score_of[piece], worst if size == 1 else -np.inf)
                total = best[here - size] + edge
                better = total > score
                score[better], step[better] = total[better], size
            best[here], back[here] = score, step
        words, ends = [], []
        for w, (start, length) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
            cut, a = [], start + length
            while a > start:
                cut.append(a)
                a -= int(back[a])
            words += [w] * len(cut)
            ends += cut[::-1]
        return np.array(words), np.array(ends)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.tolist() for x in self.encode_arrays(texts)]

    def encode_arrays(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        prefix = " " if self.model.dummy_prefix else ""
        parts = [self.split.findall((prefix + t).replace(" ", BLANK)) if t else [] for t in texts]
        wanted = set().union(*parts)
        new = wanted - self.known.keys()
        if len(self.known) + len(new) > CACHE:
            self.known, new = {}, wanted
        own = self._learn(list(new))
        self.known |= own
        find = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(find, p)), "<i4") for p in parts]
        for w in own:
            if len(w) > LONG:
                del self.known[w]
        return out

    def decode(self, ids: list[int]) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


_OUT = "doc_id long, n_tokens long, n_byte_tokens long, ids_sha256 string, round_trip boolean, ids array<int>"


def _run(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        is_byte = np.zeros(len(model.pieces), bool)
        is_byte[list(encoder.bytes_of.values())] = True
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):  # by some megabytes, as ids take more room than texts
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) < 2 << 20):
                    size += len(texts[stop])
                    stop += 1
                flat = encoder.encode_arrays(texts[at:stop])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum([len(f) for f in flat]))), pa.int32()), pa.array(np.concatenate(flat), pa.int32())
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, stop - at),
                        pa.array([len(f) for f in flat], pa.int64()),
                        pa.array([int(is_byte[f].sum()) for f in flat], pa.int64()),
                        pa.array([hashlib.sha256(f.tobytes()).hexdigest() for f in flat]),
                        pa.array([encoder.decode(f.tolist()) == t for f, t in zip(flat, texts[at:stop], strict=True)]),
                        lists,
                    ],
                    names=["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "round_trip", "ids"],
                )
                at = stop
        encoder = None
        free_memory()

    return run


def encode_documents(docs: DataFrame, model: Model | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: `doc_id`, `n_tokens`, `n_byte_tokens`, `ids_sha256` (little-endian 32-bit ids), `round_trip`, `ids`.

    `round_trip` says whether decoding the ids gives the text back; it fails only for texts that hold the blank's own
    sign U+2581. Defined results: a null or empty text has no tokens; repeated rows each get a row; ids may be null but
    must be whole numbers (or text that spells one); an empty table gives no rows; other columns are not read. A text without
    blanks is one word, whose edges take some 200 bytes a character while it is encoded.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_run(model or load_model()), _OUT)


def decode_documents(coded: DataFrame, model: Model | None = None, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of token ids: `doc_id`, `text`; null ids give a null text."""
    model = model or load_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            texts = [None if ids is None else encoder.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")

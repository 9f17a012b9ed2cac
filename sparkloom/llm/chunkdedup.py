"""Repeated passages by content-defined chunking: a gear rolling hash cuts, digests find chunks seen before.

A boundary depends on the bytes just before it only, so text inserted in one place moves no boundary further on: a
passage that occurs in two documents is cut alike in both, but for its edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import BLOCK_BYTES, prepare, stored, text_blocks
from sparkloom.llm.hashing import byte_table, content_hashes, digests, mix64

#: Bits of the gear hash that must be zero at a candidate for a boundary (one in 2**4 bytes on average).
MASK_BITS = 4
#: Bytes that the tested bits depend on; bytes within which the candidate with the smallest hash wins; bytes within which
#: the smallest hash of all is a boundary if there is no candidate; most bytes in a chunk. Chunks have about 40 bytes on
#: average, so that a passage of 50 words holds several whole ones.
WINDOW, RADIUS, FAR, MOST = 16, 16, 32, 256
#: A run of repeated chunks counts from this many bytes on, or if it is a whole text. A passage of 50 words is longer in
#: most languages even without its edges; 0 counts every repeated chunk.
RUN_BYTES = 128

_GEAR = byte_table(0x6EA2)


def _least(values: np.ndarray, radius: int) -> np.ndarray:
    """The minimum of the values within `radius` of each; nothing lies beyond the ends."""
    end = np.full(radius, np.iinfo(values.dtype).max, values.dtype)
    around = np.concatenate((end, values, end))
    have = 1
    while have < 2 * radius + 1:
        step = min(have, 2 * radius + 1 - have)
        around = np.minimum(around[:-step], around[step:])
        have += step
    return around


def _boundaries(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Places that the hash makes chunk starts; `texts` are the starts of texts, where none lie."""
    n = len(data)
    hash_ = np.zeros(n, np.uint64)
    gear = _GEAR[data]
    for k in range(min(WINDOW, n)):
        hash_[k:] += gear[: n - k] << np.uint64(k)
    hash_ &= np.uint64((1 << WINDOW) - 1)
    # Candidates rank before all other hashes.
    none, other = np.uint32(0xFFFFFFFF), np.uint32(1 << 30)
    rank = (mix64(hash_) >> np.uint64(34)).astype(np.uint32)
    rank[(hash_ >> np.uint64(WINDOW - MASK_BITS)) != 0] += other
    # Hashes that reach over a text's start do not count.
    early = texts[:, None] + np.arange(WINDOW - 1)
    rank[early[early < n]] = none
    # Texts lie so far apart that they do not see each other.
    lengths = np.diff(np.concatenate((texts[1:] if len(texts) else texts, [n])), prepend=0)
    at = np.arange(n) + np.repeat(np.arange(len(lengths)) * FAR, lengths)
    apart = np.full(n + FAR * (len(lengths) - 1), none)
    apart[at] = rank
    hit = (rank < other) & (rank == _least(apart, RADIUS)[at])
    hit |= (rank != none) & (rank == _least(apart, FAR)[at])
    return np.flatnonzero(hit) + 1  # a chunk starts after the byte that completes the hash


def chunk_starts(data: np.ndarray, offsets: np.ndarray, piece: int = 4 * BLOCK_BYTES) -> np.ndarray:
    """Sorted starts of all chunks of a block of texts.

    The gear hash h = 2 h + gear[byte] is a sum of shifted table entries, so its bit WINDOW - 1 is decided by the last
    WINDOW bytes; the tested bits are the topmost ones of those. A candidate becomes a boundary if none within RADIUS
    bytes has a smaller hash: that, too, is decided locally. Where no candidate lies within FAR bytes, the smallest hash
    of those is a boundary. As the smallest hash of a period is a boundary in each of its repetitions (but for FAR bytes
    at the edges), periodic text is cut at its period. Chunks over MOST bytes are cut evenly from their start on.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    texts = np.unique(offsets[:-1][np.diff(offsets) > 0])
    if n > piece and len(texts) == 1:
        # A long text by pieces, each with the bytes around it that its boundaries depend on.
        around, hits, none = WINDOW + 2 * FAR, [], np.zeros(0, np.int64)
        for at in range(0, n, piece):
            first = max(0, at - around)
            own = _boundaries(data[first : at + piece + around], texts if not first else none) + first
            hits.append(own[(own > at) & (own <= at + piece)])
        hit = np.concatenate(hits)
    else:
        hit = _boundaries(data, texts)
    hit = hit[hit < n]
    starts = np.union1d(texts, hit)
    length = np.diff(np.concatenate((starts, [n])))
    parts = np.maximum(1, -(-length // MOST))
    first = np.repeat(starts, parts)
    step = np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)
    return first + step * MOST


def _pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, bytes, row offsets, and starts and ends of chunks, for some chunks at a time."""
    for first, _, data, offsets in text_blocks(column):
        start = chunk_starts(data, offsets)
        end = np.concatenate((start[1:], [len(data)]))
        cuts = np.searchsorted(start, np.arange(0, len(data) + 4 * BLOCK_BYTES, 4 * BLOCK_BYTES))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a < b:
                yield first, data, offsets, start[a:b], end[a:b]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All chunks with a hash of their content (`d1`) and a keyed digest (`d2`), which make 128 bits together."""
    for batch in batches:
        for first, data, offsets, start, end in _pieces(batch.column("text")):
            row = np.searchsorted(offsets, start, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row + first)),
                    batch.column("tk").take(pa.array(row + first)),
                    pa.array((start - offsets[row]).astype(np.int32)),
                    pa.array((end - offsets[row]).astype(np.int32)),
                    pa.array(end == offsets[row + 1]),
                    pa.array(content_hashes(data, start, end).view(np.int64)),
                    pa.array(np.ascontiguousarray(digests(data, start, end)[:, 0]).view(np.int64)),
                ],
                names=["doc_id", "tk", "start", "end", "last", "d1", "d2"],
            )


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block of texts, the distinct hashes of chunks, and whether they occur more than once in it."""
    for batch in batches:
        for _, data, _, start, end in _pieces(batch.column("text")):
            found, count = np.unique(content_hashes(data, start, end).view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(count > 1)], names=["d1", "twice"])


def repeated_chunks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All chunks whose content occurs more than once: `doc_id`, `tk` (hash of the text), `start`, `end`, `last` (of its text), `first`.

    `first` marks the occurrence that is kept: the one in the smallest (doc_id, tk), at its smallest start.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tk"))
    # Half a digest is enough to drop the chunks that occur once; what is left is compared by the whole one.
    counts = texts.mapInArrow(_distinct, "d1 long, twice boolean").groupBy("d1").agg(F.count("*").alias("blocks"), F.bool_or("twice").alias("twice"))
    many = stored(counts.where("blocks > 1 or twice").select("d1"), "digests")
    places = texts.mapInArrow(_chunks, "doc_id long, tk long, start int, end int, last boolean, d1 long, d2 long")
    places = stored(places.join(many, "d1", "left_semi"), "chunks")
    keep = places.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "tk", "start")).alias("keep"), F.count("*").alias("times"))
    first = F.struct("doc_id", "tk", "start").eqNullSafe(F.col("keep"))
    keep = stored(keep.where("times > 1"), "kept")  # as a table of its own, so that the join can split a chunk found very often
    return places.join(keep, ["d1", "d2"]).select("doc_id", "tk", "start", "end", "last", first.alias("first"))


def dedup_chunks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", run_bytes: int = RUN_BYTES) -> DataFrame:
    """Per row: `doc_id`, `n_bytes`, `n_repeated` and `repeated` (runs of repeated chunks), `n_removed` and `removed`.

    A run is a maximal stretch of chunks whose content occurs elsewhere, of `run_bytes` bytes at least, or the whole text;
    `repeated` holds the runs in every document that has the passage, `removed` those that a deduplicated corpus drops:
    stretches of chunks that are not the first occurrence of their content. Ranges are UTF-8 byte offsets. With
    `run_bytes=0` every chunk whose content occurs twice is in a run.

    Defined results: a null or empty text has no chunks; of repeated rows (equal id and text) every row gets the same
    answer, so one of them at least should be dropped beforehand where ids repeat; null ids come before all others;
    other columns are not read.
    """
    found = repeated_chunks(docs, id_col=id_col, text_col=text_col).distinct()

    def runs(chunks: DataFrame, name: str) -> DataFrame:
        """Stretches of chunks that follow each other without a gap, gathered per text; a text's chunks stream by in order."""
        text = ["doc_id", "tk"]
        in_order = W.partitionBy(*text).orderBy("start")
        new = F.coalesce(F.lag("end").over(in_order) != F.col("start"), F.lit(True)).cast("int")
        run = F.sum("new").over(in_order.rowsBetween(W.unboundedPreceding, 0))
        each = chunks.withColumn("new", new).withColumn("run", run).groupBy(*text, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.bool_or("last").alias("last"))
        each = each.where((F.col("end") - F.col("start") >= run_bytes) | ((F.col("start") == 0) & F.col("last")))
        return each.groupBy(*text).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(name))

    repeated, removed = runs(found, "repeated"), runs(found.where("not first"), "removed")
    same = F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("tk") == F.col("o_tk"))
    removed = removed.select(F.col("doc_id").alias("o_id"), F.col("tk").alias("o_tk"), "removed")
    runs_ = repeated.join(removed, same, "left").select(F.col("doc_id").alias("r_id"), F.col("tk").alias("r_tk"), "repeated", "removed")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tk"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.join(runs_, rows.doc_id.eqNullSafe(runs_.r_id) & (rows.tk == runs_.r_tk), "left")
    none = F.expr("CAST(array() AS array<struct<start: int, end: int>>)")
    length = "aggregate({0}, 0L, (t, r) -> t + r.end - r.start)"
    out = out.withColumn("repeated", F.coalesce("repeated", none)).withColumn("removed", F.coalesce("removed", none))
    return out.select(
        "doc_id", "n_bytes", F.expr(length.format("repeated")).alias("n_repeated"), F.expr(length.format("removed")).alias("n_removed"), "repeated", "removed"
    )

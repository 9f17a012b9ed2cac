"""Exact removal of repeated byte strings by prefix-free parsing and suffix arrays.

A window is a string of `width` bytes inside one text. Every window has a trigger: the place with the smallest rolling
hash in its middle. Consecutive windows with the same trigger form a phrase, from the first window's start to the last
one's end, so phrases overlap by less than a window and every window lies in exactly one phrase (the parse). Equal
windows have the same trigger with the same bytes around it, so a window can only repeat within its trigger's key.

1. The parse of all texts gives for each phrase a keyed BLAKE2 digest and its trigger's key. Counting digests gives the dictionary:
   a phrase seen twice has all of its windows repeated, one whose key is seen once has none.
2. Only keys that hold both several phrases and phrases seen once remain open. Their dictionary entries, one copy of
   each, are gathered by key, and a suffix array over the concatenated entries, sorted as far as a window's width,
   brings equal windows next to each other.
3. The parse carries the verdicts back to the texts.

Repetitive text thus costs what its dictionary costs. A key with very many entries is dealt out by the keyed digests
of its windows instead of being gathered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import BLOCK_BYTES, prepare, stored, text_blocks
from sparkloom.llm.hashing import Fingerprints, digests, mix64

#: Bytes of the rolling hash that picks triggers, and its least distance from either end of a window.
GRAM, MARGIN = 16, 22
#: A key with more distinct phrases than this is matched by its windows' keyed digests over all tasks.
HOT_PHRASES = 5_000
#: Bytes of dictionary entries in one suffix array; a single key may exceed it by HOT_PHRASES entries at most.
ARRAY_BYTES = 1 << 20

_DUP, _COPY, _SINGLE, _HOT_COPY, _HOT_SINGLE = 1, 2, 3, 4, 5


def parse(data: np.ndarray, offsets: np.ndarray, width: int, piece: int = 4 * BLOCK_BYTES) -> dict[str, np.ndarray]:
    """Phrases of a block of texts: row, first and last window start in the text, trigger key and phrase digest.

    A single text longer than `piece` is cut into pieces by window starts. A phrase that a cut parts has digests of its
    own, but its windows keep their trigger and so their key, within which they are compared in any case.
    """
    n = len(data)
    if len(offsets) == 2 and n > piece + width:
        parts = []
        for at in range(0, n - width + 1, piece):
            part = data[at : at + piece + width - 1]
            parts.append(parse(part, np.array([0, len(part)]), width, n))
            parts[-1]["lo"], parts[-1]["hi"] = parts[-1]["lo"] + at, parts[-1]["hi"] + at
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    starts = np.zeros(n + 1, np.int32)
    long_ = np.diff(offsets) >= width
    np.add.at(starts, offsets[:-1][long_], 1)
    np.add.at(starts, offsets[1:][long_] - width + 1, -1)
    starts = np.flatnonzero(np.cumsum(starts[:-1]))
    if not len(starts):
        z = np.zeros(0, np.int64)
        return {"row": z, "lo": z, "hi": z, "k": z, "c": z}
    fp = Fingerprints(data)
    best = (fp.rolling(GRAM) >> np.uint64(32) << np.uint64(32)) | np.arange(n - GRAM + 1, dtype=np.uint64)
    span, have = width - 2 * MARGIN - GRAM + 1, 1
    while have < span:
        step = min(have, span - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    trigger = (best[starts + MARGIN] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], trigger[1:] != trigger[:-1])))
    lo, hi, trigger = starts[new], starts[np.concatenate((new[1:], [len(starts)])) - 1], trigger[new]
    key = fp(trigger - MARGIN, trigger + GRAM + MARGIN)
    digest = mix64(digests(data, lo, hi + width)[:, 0] + (trigger - lo).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    row = np.searchsorted(offsets, lo, "right") - 1
    return {"row": row, "lo": lo - offsets[row], "hi": hi - offsets[row], "k": key.view(np.int64), "c": digest.view(np.int64)}


def window_classes(entries: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of concatenated entries, as far as `width` bytes.

    Returns the entry bounds and, for every place where a window fits into its entry, whether an equal window starts
    elsewhere (False where none fits). Suffixes are sorted by 8 bytes, then by doubling.
    """
    data = np.frombuffer(b"".join(entries) + bytes(8), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(e) for e in entries])))
    n = len(data) - 8
    rank = np.zeros(n, np.uint64)
    for k in range(8):
        rank = rank << np.uint64(8) | data[k : k + n]
    have = 8
    rank = _dense(rank)
    while have < width:
        step = min(have, width - have)
        far = np.zeros(n, np.uint64)
        far[: n - step] = rank[step:] + np.uint64(1) if step < n else 0
        rank = _dense(rank * np.uint64(n + 2) + far)
        have += step
    fits = np.zeros(n + 1, np.int32)
    length = np.diff(bounds)
    np.add.at(fits, bounds[:-1][length >= width], 1)
    np.add.at(fits, (bounds[1:] - width + 1)[length >= width], -1)
    places = np.flatnonzero(np.cumsum(fits[:-1]))
    repeated = np.zeros(n, bool)
    if len(places):
        count = np.bincount(rank[places].astype(np.int64))
        repeated[places] = count[rank[places].astype(np.int64)] > 1
    return bounds, repeated


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 0, equal for equal keys."""
    order = np.argsort(keys)
    by = keys[order]
    rank = np.empty(len(keys), np.uint64)
    rank[order] = np.cumsum(np.concatenate(([0], by[1:] != by[:-1]))).astype(np.uint64)
    return rank


def _count(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks, cs = [], []
            for _, _, data, offsets in text_blocks(batch.column("text")):
                p = parse(data, offsets, width)
                ks.append(p["k"])
                cs.append(p["c"])
            if ks:
                k, c = np.concatenate(ks), np.concatenate(cs)
                order = np.lexsort((c, k))
                k, c = k[order], c[order]
                new = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))) if len(k) else np.zeros(0, int)
                m = np.diff(np.concatenate((new, [len(k)])))
                yield pa.RecordBatch.from_arrays([pa.array(k[new]), pa.array(c[new]), pa.array(m, pa.int64())], names=["k", "c", "m"])

    return run


def _occurrences(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in text_blocks(batch.column("text")):
                p = parse(data, offsets, width)
                rows = pa.array(p["row"] + first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("tk").take(rows), pa.array(p["lo"], pa.int32()), pa.array(p["hi"], pa.int32()), pa.array(p["k"]), pa.array(p["c"])],
                    names=["doc_id", "tk", "lo", "hi", "k", "c"],
                )

    return run


def _lists(column: pa.Array) -> Iterator[dict[str, np.ndarray] | None]:
    """The structs of each row's list, as numpy arrays by field; None for a null list."""
    for k in range(len(column)):
        if not column[k].is_valid:
            yield None
            continue
        v = column[k].values
        yield {f.name: v.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(v.type)}


def _extract(width: int, hot: bool):
    """Dictionary entries out of the texts: their bytes, or for keys with very many entries their windows' digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tks = batch.column("doc_id"), batch.column("tk")
            out: list[list] = [[] for _ in range(6)]
            for i, work in enumerate(_lists(batch.column("work"))):
                kind = work["kind"]
                pick = np.flatnonzero(np.isin(kind, (_HOT_COPY, _HOT_SINGLE) if hot else (_COPY, _SINGLE)))
                if not len(pick):
                    continue
                text = batch.column("text")[i].as_buffer()
                text = np.frombuffer(text, np.uint8)
                for j in pick.tolist():
                    lo, hi = int(work["lo"][j]), int(work["hi"][j])
                    each = np.arange(lo, hi + 1) if hot else [lo]
                    out[0] += [i] * len(each)
                    out[1] += [int(work["k"][j])] * len(each)
                    out[2] += [kind[j] in (_SINGLE, _HOT_SINGLE)] * len(each)
                    out[3] += list(map(int, each))
                    out[4] += np.ascontiguousarray(digests(text, each, each + width)[:, 0]).view(np.int64).tolist() if hot else [text[lo : hi + width].tobytes()]
                    if len(out[0]) > 20_000:
                        yield _entries(ids, tks, out, hot)
                        out = [[] for _ in range(6)]
            if out[0]:
                yield _entries(ids, tks, out, hot)

    return run


def _entries(ids: pa.Array, tks: pa.Array, out: list[list], hot: bool) -> pa.RecordBatch:
    rows = pa.array(out[0])
    return pa.RecordBatch.from_arrays(
        [ids.take(rows), tks.take(rows), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.int64() if hot else pa.binary())],
        names=["doc_id", "tk", "k", "single", "lo", "entry"],
    )


_ENTRY = "doc_id long, tk long, k long, single boolean, lo int, entry "


def _match(width: int):
    """Repeated windows of entries seen once; rows come sorted by key, and arrays are cut between keys."""

    def found(rows: list[tuple]) -> pa.RecordBatch:
        bounds, repeated = window_classes([r[4] for r in rows], width)
        edge = np.diff(np.concatenate(([0], repeated.view(np.int8), [0])))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        row = np.searchsorted(bounds, s, "right") - 1
        single = np.array([r[2] for r in rows], bool)[row]
        s, e, row = s[single], e[single], row[single]
        lo = np.array([r[3] for r in rows], np.int64)[row] - bounds[row]
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[r][0] for r in row], pa.int64()), pa.array([rows[r][1] for r in row], pa.int64()), pa.array(s + lo, pa.int32()), pa.array(e + lo, pa.int32())],
            names=["doc_id", "tk", "lo", "hi"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "tk", "single", "lo", "entry")]
            for k, *row in zip(batch.column("k").to_pylist(), *cols, strict=True):
                if k != last and size > ARRAY_BYTES:
                    yield found(rows)
                    rows, size = [], 0
                last = k
                rows.append(row)
                size += len(row[4])
        if rows:
            yield found(rows)

    return run


def _cut(width: int):
    """What stays of each text once the bytes of repeated windows are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            texts, known, more = batch.column("text"), batch.column("work"), batch.column("more")
            for i, (a, b) in enumerate(zip(_lists(known), _lists(more), strict=True)):
                text = texts[i].as_buffer() if texts[i].is_valid else b""
                n = len(text)
                lo, hi = [], []
                for x in (a, b):
                    if x is not None:
                        sure = x["kind"] == _DUP if "kind" in x else slice(None)
                        lo.append(x["lo"][sure])
                        hi.append(x["hi"][sure])
                spans = merged(np.concatenate(lo), np.concatenate(hi) + width) if lo else np.zeros((0, 2), np.int64)
                view, sha, at, kept = memoryview(text), hashlib.sha256(), 0, []
                for s, e in [*spans.tolist(), [n, n]]:
                    kept.append(view[at:s])
                    sha.update(kept[-1])
                    at = e
                out[0].append(n)
                out[1].append(int((spans[:, 1] - spans[:, 0]).sum()))
                out[2].append(len(spans))
                out[3].append(sha.hexdigest())
                out[4].append(b"".join(kept) if "want" in batch.schema.names else None)
                out[5].append([{"start": s, "end": e} for s, e in spans.tolist()])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"],
            )

    return run


def merged(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Union of half-open ranges as maximal runs; ranges that touch are one run."""
    if not len(lo):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order].astype(np.int64), np.maximum.accumulate(hi[order].astype(np.int64))
    first = np.concatenate(([True], lo[1:] > hi[:-1]))
    last = np.concatenate((first[1:], [True]))
    return np.stack((lo[first], hi[last]), axis=1)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 200, with_text: bool = False) -> DataFrame:
    """Removes from every text each byte covered by a string of `width` bytes that also starts anywhere else.

    Texts are UTF-8 bytes; strings never cross texts; copies within one text count; all is judged on the input. Returns
    one row per row of `docs`: `doc_id`, `n_bytes`, `n_removed`, `n_spans` (maximal removed runs), `kept_sha256` of the
    remaining bytes, `spans`, and `kept` (the remaining bytes, with `with_text`; else null). A cut can fall inside a
    character, so `kept` is binary.

    Defined results: a null text counts as empty; repeated rows are copies of each other, so both lose their repeated
    bytes; null or repeated ids do no harm; other columns are not read. `width` must be over 60.
    """
    if width < 2 * MARGIN + GRAM + 1:
        raise ValueError("width is too small for triggers")
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tk"))
    counts = texts.select("text").mapInArrow(_count(width), "k long, c long, m long")
    # One shuffle by key serves both levels; rows are counted per batch before it, so copies do not pile up.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = counts.repartition(n, "k").groupBy("k", "c").agg(F.sum("m").alias("m"))
    key = W.partitionBy("k")
    counts = counts.select(
        "k", "c", "m", F.count("*").over(key).alias("kinds"), F.sum((F.col("m") == 1).cast("long")).over(key).alias("singles"), F.sum("m").over(key).alias("total")
    ).where("total > 1")
    status = counts.selectExpr("k", "c", "m > 1 AS dup", "kinds > 1 AND singles > 0 AS open", f"kinds > {HOT_PHRASES} AS hot")
    status = stored(status, "dictionary")
    places = texts.mapInArrow(_occurrences(width), "doc_id long, tk long, lo int, hi int, k long, c long")
    places = stored(places.join(status, ["k", "c"]), "parse")
    kind = F.when(F.col("hot"), F.when(F.col("dup"), _HOT_COPY).otherwise(_HOT_SINGLE)).otherwise(F.when(F.col("dup"), _COPY).otherwise(_SINGLE))
    entries = places.where("open").groupBy("k", "c", "dup", "hot").agg(F.min(F.struct("doc_id", "tk", "lo", "hi")).alias("p"))
    item = "struct(int(lo) AS lo, int(hi) AS hi, bigint(k) AS k, int(kind) AS kind) AS item"
    work = places.where("dup").withColumn("kind", F.lit(_DUP)).selectExpr("doc_id", "tk", item)
    work = work.unionByName(entries.withColumn("kind", kind).select("p.*", "k", "kind").selectExpr("doc_id", "tk", item))
    work = work.groupBy("doc_id", "tk").agg(F.collect_list("item").alias("work"))

    def beside(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
        r = right.select(F.col("doc_id").alias("r_id"), F.col("tk").alias("r_tk"), column)
        return left.join(r, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("tk") == F.col("r_tk")), "left").drop("r_id", "r_tk")

    joined = stored(beside(texts, work, "work"), "texts")

    def has(*kinds: int):
        return F.expr(f"coalesce(exists(work, x -> x.kind IN ({', '.join(map(str, kinds))})), false)")

    cold = joined.where(has(_COPY, _SINGLE)).mapInArrow(_extract(width, False), _ENTRY + "binary")
    found = cold.repartition(n, "k").sortWithinPartitions("k").mapInArrow(_match(width), "doc_id long, tk long, lo int, hi int")
    hot = joined.where(has(_HOT_COPY, _HOT_SINGLE)).mapInArrow(_extract(width, True), _ENTRY + "long")
    hot = stored(hot, "windows")
    twice = hot.groupBy("k", "entry").count().where("count > 1").drop("count")
    hot = hot.where("single").join(twice, ["k", "entry"], "left_semi").select("doc_id", "tk", "lo", F.col("lo").alias("hi"))
    more = found.unionByName(hot).groupBy("doc_id", "tk").agg(F.collect_list(F.struct("lo", "hi")).alias("more"))
    open_ = has(_SINGLE, _HOT_SINGLE)
    ready = joined.where(~open_).withColumn("more", F.lit(None).cast("array<struct<lo:int,hi:int>>"))
    rest = beside(joined.where(open_), more, "more")
    both = ready.unionByName(rest).drop("tk")
    if with_text:
        both = both.withColumn("want", F.lit(True))
    return both.mapInArrow(
        _cut(width),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>",
    )

"""Exact top-k search by inner product over a pivot-distance index.

Inner products become distances by one more component: with R the largest norm, a vector x is lifted to
(x, sqrt(R^2 - |x|^2)), a query to (q, 0); then |q' - x'|^2 = |q|^2 + R^2 - 2 <q, x>, so the highest scores are the
nearest lifted vectors and the triangle inequality holds.

Index: pivots are chosen farthest-first from a bounded sample; every vector is keyed by its nearest pivot and its
distance to it. Range partitioning by (pivot, distance, id) deals the keys out evenly, however many vectors one pivot
or one distance holds, and runs of bounded length in that order become annuli, each one row: pivot, distance range,
ids and vectors. Annuli of one pivot, up to a bounded number of bytes, make a part.

Search: queries are keyed and packed into blocks of bounded size in the same way, each query with the score that the
k-th best of the sample reaches, below which nothing is wanted. Blocks are listed against parts by pivot; a pair stays
only where the block's range of distances to the pivot comes as close to the part's as some query's bound demands. One
shuffle brings parts and their blocks together, and a task holds one part at a time while its blocks stream by. For each
block it expands the part's annuli sorted by the gap between the queries' distances to the pivot and the annulus' range,
and stops for a query once the gap exceeds the distance of its k-th best so far: by the triangle inequality nothing
further out can do better. All is one job over tables; the driver sees the sample and counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import prepare, stored

#: Pivots, and the rows of the sample that they are chosen from (the index holds all rows in any case).
PIVOTS, SAMPLE = 32, 2048
#: Vectors in an annulus at most; queries in a block, and bytes of their vectors, at most; bytes of a part's vectors.
ANNULUS, QUERIES, QUERY_BYTES, PART_BYTES = 1024, 4096, 4 << 20, 16 << 20
#: Slack on squared distances for rounding, relative to R^2.
_SLACK = 1e-9
#: Stands for a bound that is not known yet.
_LOWEST = np.iinfo(np.int64).min

_INDEX = "part long, pivot int, near double, far double, ids binary, vectors binary"
_BLOCK = "block long, ids binary, vectors binary, floors binary, reach double, low array<double>, high array<double>"


def to_matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are non-null lists of finite numbers, and their values; shorter vectors are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    good = (bad[offsets[1:]] == bad[offsets[:-1]]) & np.asarray(column.is_valid())
    rows = np.flatnonzero(good)
    length = np.diff(offsets)[rows]
    width = int(length.max()) if len(rows) else 0
    out = np.zeros((len(rows), width))
    if width:
        inside = np.arange(width) < length[:, None]
        out[inside] = values[(offsets[:-1][rows][:, None] + np.arange(width))[inside]]
    assert n == len(offsets) - 1
    return rows, out


def _quantised(scale: float):
    """Keeps the rows that take part, as scaled whole numbers in doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = to_matrix(batch.column("v"))
            x = np.clip(np.floor(x * scale), -(2.0**62), 2.0**62)
            ids = batch.column("id").take(pa.array(rows))
            norm = np.sqrt((x * x).sum(axis=1)) if len(rows) else np.zeros(0)
            vectors = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, vectors, pa.array(norm)], names=["id", "v", "norm"])

    return run


def _stack(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for k, v in enumerate(column.to_pylist()):
        row = np.frombuffer(v)
        out[k, : len(row)] = row
    return out


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each next pivot is the sample point with the greatest distance to those before it."""
    if not len(sample):
        return sample
    picked, far = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(picked) < min(count, len(sample)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
    return sample[picked]


def _lift(x: np.ndarray, radius2: float) -> np.ndarray:
    return np.concatenate((x, np.sqrt(np.maximum(radius2 - (x * x).sum(axis=1), 0))[:, None]), axis=1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(d, 0))


def _keyed(pivots: np.ndarray, radius2: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _lift(_stack(batch.column("v"), pivots.shape[1] - 1), radius2)
            d = _distances(x, pivots)
            best = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(best, pa.int32()), pa.array(d[np.arange(len(x)), best]), batch.column("id"), batch.column("v")], names=["pivot", "distance", "id", "v"]
            )

    return run


def _annuli(width: int, rows: int):
    """Packs sorted rows into annuli of one pivot and at most `rows` vectors, and numbers the parts they make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        state = {"part": (task.partitionId() if task else 0) << 24, "bytes": 0, "pivot": None}

        def pack(pivot: int, part: list[tuple]) -> pa.RecordBatch:
            x = np.zeros((len(part), width))
            for k, (_, _, v) in enumerate(part):
                r = np.frombuffer(v)
                x[k, : len(r)] = r
            if len(x) and np.abs(x).max(initial=0) < 2**15:
                x = x.astype(np.int16)
            if state["pivot"] not in (None, pivot) or state["bytes"] > PART_BYTES:
                state.update(part=state["part"] + 1, bytes=0)
            state.update(pivot=pivot, bytes=state["bytes"] + x.nbytes)
            ids = np.array([p[1] for p in part], np.int64)
            arrays = [[state["part"]], [pivot], [part[0][0]], [part[-1][0]], [ids.tobytes()], [x.dtype.char.encode() + x.tobytes()]]
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, kinds, strict=True)], names=["part", "pivot", "near", "far", "ids", "vectors"])

        last, part = None, []
        for batch in batches:
            for pivot, *row in zip(*(batch.column(c).to_pylist() for c in ("pivot", "distance", "id", "v")), strict=True):
                if part and (pivot != last or len(part) >= rows):
                    yield pack(last, part)
                    part = []
                last = pivot
                part.append(row)
        if part:
            yield pack(last, part)

    return run


def _blocks(pivots: np.ndarray, radius2: float, k: int, sample: np.ndarray, sample_ids: np.ndarray, size: int):
    """Packs sorted queries into blocks, each with its queries' floors and its range of distances to every pivot."""
    width = pivots.shape[1] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 24

        def pack(part: list[tuple]) -> pa.RecordBatch:
            nonlocal number
            number += 1
            ids = np.array([p[0] for p in part], np.int64)
            q = np.zeros((len(part), width))
            for i, (_, v) in enumerate(part):
                r = np.frombuffer(v)
                q[i, : len(r)] = r
            floors = np.full(len(q), _LOWEST)
            for at in range(0, len(q), 512):
                scores = _products(q[at : at + 512], sample).copy()
                scores[ids[at : at + 512, None] == sample_ids[None, :]] = _LOWEST
                if scores.shape[1] >= k:
                    floors[at : at + 512] = -np.partition(-scores.clip(-(2**62)), k - 1, axis=1)[:, k - 1]
            floors[floors <= -(2**62)] = _LOWEST
            d = _distances(np.concatenate((q, np.zeros((len(q), 1))), axis=1), pivots)
            reach = float(_reach(q, radius2, floors).max())
            arrays = [[number], [ids.tobytes()], [q.tobytes()], [floors.tobytes()], [reach], [d.min(axis=0).tolist()], [d.max(axis=0).tolist()]]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, kinds, strict=True)], names=["block", "ids", "vectors", "floors", "reach", "low", "high"])

        part: list[tuple] = []
        for batch in batches:
            for row in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                part.append(row)
                if len(part) >= size:
                    yield pack(part)
                    part = []
        if part:
            yield pack(part)

    return run


def _reach(q: np.ndarray, radius2: float, bound: np.ndarray) -> np.ndarray:
    """Squared distance within which a vector must lie to score `bound` or more; unlimited without a bound."""
    norm2 = (q * q).sum(axis=1)
    slack = _SLACK * (radius2 + norm2.max(initial=0.0) + 1)
    return np.where(bound == _LOWEST, np.inf, norm2 + radius2 - 2.0 * bound + slack)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole-number inner products: by doubles where they are exact, else with Python's integers, held to 64 bits."""
    most = (np.abs(q).max() if q.size else 0) * (np.abs(x).max() if x.size else 0) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ x.T.astype(np.float64)).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    out = exact(q).dot(exact(x).T)
    return np.clip(out, -(2**63), 2**63 - 1).astype(np.int64)


def _best(queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, pivots: np.ndarray, radius2: float, k: int, annuli: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each query among a part's annuli (pivot, near, far, ids, vectors), as far as they reach its floor."""
    to_pivot = _distances(np.concatenate((queries, np.zeros((len(queries), 1))), axis=1), pivots)
    scores = np.full((len(queries), k), _LOWEST)
    ids = np.full((len(queries), k), np.iinfo(np.int64).max)
    filled, bound = np.zeros(len(queries), np.int64), floors.copy()

    def take(which: np.ndarray, x: np.ndarray, x_ids: np.ndarray) -> None:
        s = _products(queries[which], x)
        same = query_ids[which][:, None] == x_ids[None, :]
        for row, q in enumerate(which.tolist()):
            fit = np.flatnonzero((s[row] >= bound[q]) & ~same[row])
            if not len(fit):
                continue
            all_s = np.concatenate((scores[q, : filled[q]], s[row, fit]))
            all_i = np.concatenate((ids[q, : filled[q]], x_ids[fit]))
            order = np.lexsort((all_i, ~all_s))[:k]
            filled[q] = len(order)
            scores[q, : len(order)], ids[q, : len(order)] = all_s[order], all_i[order]
            if len(order) == k:
                bound[q] = max(bound[q], all_s[order[-1]])

    pivot, near, far = (np.array([a[i] for a in annuli]) for i in range(3))
    d = to_pivot[:, pivot]
    gap = np.maximum(np.maximum(near - d, d - far), 0)
    # Annuli in the order of their smallest gap to any query; each serves the queries it can still help.
    for a in np.argsort(gap.min(axis=0), kind="stable").tolist():
        which = np.flatnonzero(gap[:, a] ** 2 <= _reach(queries, radius2, bound))
        if len(which):
            raw = annuli[a][4]
            x_ids = np.frombuffer(annuli[a][3], np.int64)
            take(which, np.frombuffer(raw, np.dtype(raw[:1].decode()), offset=1).reshape(len(x_ids), queries.shape[1]), x_ids)
    q = np.repeat(np.arange(len(queries)), filled)
    at = np.concatenate([np.arange(n) for n in filled]).astype(np.int64) if len(filled) else np.zeros(0, np.int64)
    return query_ids[q], ids[q, at], scores[q, at]


def _search(pivots: np.ndarray, radius2: float, k: int):
    """Rows come sorted by part, annuli before blocks: one part is held, its blocks stream by."""
    width = pivots.shape[1] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, annuli = None, []
        names = ("number", "floors", "pivot", "near", "far", "ids", "vectors")
        for batch in batches:
            for number, floors, *annulus in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if number != part:
                    part, annuli = number, []
                if floors is None:
                    annuli.append(annulus)
                elif annuli:
                    ids = np.frombuffer(annulus[3], np.int64)
                    q = np.frombuffer(annulus[4]).reshape(len(ids), width)
                    found = _best(q, ids, np.frombuffer(floors, np.int64), pivots, radius2, k, annuli)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    return run


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 1024.0,
    pivots: int = PIVOTS,
    sample: int = SAMPLE,
    annulus: int = ANNULUS,
    block: int = QUERIES,
) -> DataFrame:
    """Each query's `k` highest inner products among all vectors with another id: `query_id`, `rank`, `vec_id`, `score`.

    Components count as floor(scale * x), so scores are whole numbers and exact; ties go to the smaller id. The result
    is exact: annuli are left out only where the triangle inequality proves that they hold nothing better.

    Defined results: vectors that are null, or hold a null or a non-finite component, take no part on either side, nor
    do rows with a null id; vectors of different lengths are compared as if filled up with zeros; repeated rows appear
    as often as they are there; with fewer than k candidates, all are returned; scores beyond 64 bits are held to
    them; empty tables give no rows. Columns other than the two named are not read.
    """
    spark = vectors.sparkSession
    prepare(spark)
    kinds = "id long, v binary, norm double"

    def ready(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        return df.where("id is not null and v is not null").mapInArrow(_quantised(scale), kinds)

    rows = stored(ready(vectors), "vectors")
    asked = stored(ready(queries), "queries")
    widest = rows.select("norm", (F.length("v") / 8).alias("w")).unionByName(asked.select(F.lit(0.0).alias("norm"), (F.length("v") / 8).alias("w")))
    radius, width = widest.agg(F.max("norm"), F.max("w")).first()
    if radius is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, radius2 = int(width), float(radius) ** 2
    few = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "v").toPandas()
    base = np.zeros((len(few), width))
    for i, v in enumerate(few["v"]):
        r = np.frombuffer(v)
        base[i, : len(r)] = r
    chosen = choose_pivots(_lift(base, radius2), pivots)
    if not len(chosen):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def sorted_by_key(df: DataFrame, *parts: int) -> DataFrame:
        keyed = df.mapInArrow(_keyed(chosen, radius2), "pivot int, distance double, id long, v binary")
        return keyed.repartitionByRange(*parts, "pivot", "distance", "id").sortWithinPartitions("pivot", "distance", "id")

    tasks = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = stored(sorted_by_key(rows, tasks).mapInArrow(_annuli(width, annulus), _INDEX), "annuli")
    parts = index.groupBy("part", "pivot").agg(F.min("near").alias("near"), F.max("far").alias("far"))
    # Parts are numbered without gaps, so that tasks get even shares of them; there is one row for each PART_BYTES of vectors.
    parts = stored(parts.withColumn("number", (F.row_number().over(W.orderBy("part")) - 1).cast("long")), "parts")
    size = max(1, min(block, QUERY_BYTES // (8 * max(1, width))))
    packed = _blocks(chosen, radius2, k, base, few["id"].to_numpy(np.int64), size)
    blocks = stored(sorted_by_key(asked).mapInArrow(packed, _BLOCK), "blocks")
    ranges = blocks.select("block", "reach", F.posexplode(F.arrays_zip("low", "high")).alias("pivot", "d"))
    gap = F.greatest(F.col("near") - F.col("d.high"), F.col("d.low") - F.col("far"), F.lit(0.0))
    pairs = ranges.join(parts, "pivot").where(gap * gap <= F.col("reach")).select("block", "number")
    none = F.lit(None)
    asking = pairs.join(blocks, "block").select("number", "block", "floors", none.cast("int").alias("pivot"), none.cast("double").alias("near"), none.cast("double").alias("far"), "ids", "vectors")
    held = index.join(parts.select("part", "number"), "part").select("number", F.lit(-1).cast("long").alias("block"), none.cast("binary").alias("floors"), "pivot", "near", "far", "ids", "vectors")
    count = max(1, min(parts.count(), 8 * tasks))
    rows_ = held.unionByName(asking).repartitionById(count, F.pmod("number", F.lit(count)).cast("int")).sortWithinPartitions("number", "block", "near")
    hits = rows_.mapInArrow(_search(chosen, radius2, k), "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union by label contraction.

The flow, for a corpus of any size:

1. One pass over the texts makes each document's set of word shingles and from it a SuperMinHash signature: every
   element draws its ranks along one permutation of the bins, so ranks are correlated and spread evenly over the bins,
   and drawing stops as soon as no bin of the document can still fall.
2. Documents with equal sets form a class at once (a pre-aggregated group-by); only classes go on, under numbers of their
   own, so that ids may be null or repeat.
3. The signature is cut into bands; classes that agree in a band meet in a bucket. Within a bucket, members are
   compared with one hub, not with each other, and confirmed links are contracted at once. Buckets whose members are
   all in one component by then are done. After some bands have done the bulk in this way, the remaining pairs of
   different components that share a bucket in any band are each compared, so no candidate is left out.
4. A link is confirmed on the full shingle sets, never on the signature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import free_memory, prepare, stored, text_blocks
from sparkloom.llm.hashing import mix64
from sparkloom.llm.words import shingle_sets

#: 40 bands of 6 rows find a pair with similarity 0.8 with probability 1 - 5e-6, one with 0.3 with 0.03.
BANDS, ROWS = 40, 6
#: Buckets with more members than this take the prefix filter.
CROWD = 16
#: Rows on either side of a shingle's meeting that one task compares; shingles of more rows are dealt over a grid of tasks.
CELL = 64
#: Elements that get a permutation at once, BANDS * ROWS bytes each.
_ELEMENTS = 1 << 16


def superminhash(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """SuperMinHash signatures of sets of 64-bit hashes, one row of `bins` numbers for each set (`bins` <= 256).

    Step j of an element draws a number in [j, j + 1) and puts it in the j-th bin of the element's own permutation
    (Fisher-Yates, drawn step by step). All elements take a step together; a set leaves as soon as all of its bins hold
    numbers below the next step's. Numbers are kept as integers: the step above, 32 random bits below.
    """
    out = np.full((len(sets), bins), np.iinfo(np.uint64).max, np.uint64)
    first = 0
    sizes = np.array([len(s) for s in sets], np.int64)
    while first < len(sets):
        last, total = first + 1, int(sizes[first])
        while last < len(sets) and total + sizes[last] <= _ELEMENTS:
            total += int(sizes[last])
            last += 1
        _signatures(sets[first:last], sizes[first:last], bins, out[first:last])
        first = last
    return out


def _signatures(sets: list[np.ndarray], sizes: np.ndarray, bins: int, out: np.ndarray) -> None:
    x = np.concatenate(sets)
    if not len(x):
        return
    row = np.repeat(np.arange(len(sets)), sizes)
    order = None
    for step in range(bins):
        bits = mix64(x + np.uint64((step + 1) * 0xA0761D6478BD642F % (1 << 64)))
        value = (np.uint64(step) << np.uint64(32)) | (bits >> np.uint64(32))
        k = step + (((bits & np.uint64(0xFFFFFFFF)) * np.uint64(bins - step)) >> np.uint64(32)).astype(np.int64)
        if step == 0:
            bin_, first_k = k, k
        else:
            if order is None:  # only sets that need a second step get permutations
                order = np.broadcast_to(np.arange(bins, dtype=np.uint8), (len(x), bins)).copy()
                order[np.arange(len(x)), first_k] = 0
            every = np.arange(len(x))
            bin_ = order[every, k].astype(np.int64)
            order[every, k] = order[:, step]
        np.minimum.at(out.reshape(-1), row * bins + bin_, value)
        open_ = out.max(axis=1) >= np.uint64((step + 1) << 32)
        open_ &= sizes > 0
        keep = open_[row]
        left = int(keep.sum())
        if not left:
            return
        if left < len(x) and (order is None or left < 0.7 * len(x)):
            x, row = x[keep], row[keep]
            first_k = first_k[keep] if order is None else None
            order = order if order is None else order[keep]


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band's number is part of it."""
    factor = mix64(np.arange(11, 11 + rows, dtype=np.uint64)) | np.uint64(1)
    cut = signatures.reshape(len(signatures), bands, rows)
    return mix64(mix64((mix64(cut) * factor).sum(axis=2, dtype=np.uint64)) + np.arange(1, bands + 1, dtype=np.uint64))


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _sign(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_blocks(batch.column("text")):
                sets = shingle_sets(data, offsets, size)
                keys = band_keys(superminhash(sets, bands * rows), bands, rows)
                n = np.array([len(s) for s in sets], np.int64)
                digest = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], np.uint64)
                full = np.repeat(n > 0, bands).reshape(len(n), bands)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(full.sum(axis=1)))), pa.int32()), _longs(keys[full])
                )
                own = [batch.column(c).slice(first, last - first) for c in ("doc_id", "tk")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n), _longs(digest[:, 0]), _longs(digest[:, 1]), lists], names=["doc_id", "tk", "n", "d1", "d2", "bands"])
        free_memory()

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_blocks(batch.column(1)):
                sets = shingle_sets(data, offsets, size)
                n = np.array([len(s) for s in sets], np.int64)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), _longs(np.concatenate(sets))
                )
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists], names=["node", "grams"])
        free_memory()

    return run


def _relabel(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges (a, b) with both ends replaced by their labels, the larger first; loops and repeats go."""
    a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    e = edges.join(a, "a", "left").join(b, "b", "left")
    e = e.select(F.coalesce("la", "a").alias("x"), F.coalesce("lb", "b").alias("y"))
    return e.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def contract(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame | None:
    """Union of labels along edges: (node, label) for every node that is not its own component's smallest.

    Every node hooks onto its smallest smaller neighbour, the hooks are followed to their roots by doubling, edges are
    replaced by edges between roots, and so on until none is left. All steps are joins and pre-aggregated group-bys;
    the driver only sees row counts. `labels` are earlier results to build on.
    """
    while True:
        edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        edges = stored(_relabel(edges, labels) if labels is not None else edges, "edges")
        if edges.isEmpty():
            return labels
        hooks = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("label"), F.col("label").alias("root"))
            jumped = hooks.join(up, "label", "left")
            jumped = stored(jumped.select("node", F.coalesce("root", "label").alias("label"), F.col("root").isNotNull().alias("moved")), "hooks")
            hooks = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = hooks
        else:
            up = hooks.select(F.col("node").alias("label"), F.col("label").alias("root"))
            old = labels.join(up, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
            labels = stored(old.unionByName(hooks.join(labels, "node", "left_anti")), "labels")


def _both_ways(rows: DataFrame, key: str, similar_size) -> DataFrame:
    """Pairs of nodes with equal keys, fitting sizes and different labels."""
    left = rows.select(key, F.col("node").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    right = rows.select(key, F.col("node").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    return left.join(right, key).where("a < b and la <> lb").where(similar_size("na", "nb")).select("a", "b").distinct()


def _prefixes(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of each node the rarest shingles, so many that two sets that are similar enough must share one of them.

    Shingles come in a common order, rarest first. If the first shingle that sets of n and m share has rank i in the
    first of them, they share n - i + 1 at most, which is enough for m <= `reach` only; where that is below what sizes
    allow (n * percent / 100) the shingle says nothing. Shingles of a single node are left out.
    """
    grams = nodes.join(sets, "node").select("node", "n", "label", F.explode("grams").alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("often"))
    rank = F.row_number().over(W.partitionBy("node").orderBy("often", "gram"))
    ranked = grams.join(often, "gram").withColumn("rank", rank)
    ranked = ranked.withColumn("reach", F.expr(f"((n - rank + 1) * {100 + percent}) div {percent} - n"))
    return ranked.where(F.col("reach") * 100 >= F.col("n") * percent).where("often > 1").drop("rank", "often")


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes with different labels that can be similar enough, by an exact prefix filter.

    Of a pair, the larger set asks and the smaller one answers. Answers are keyed by shingle and size class, and a
    shingle is asked only in the classes that it can still serve: sets that share but a passage, or differ a little too
    much, do not meet. Where most rows of a key belong to one component, these do not meet each other either.
    """
    rows = _prefixes(nodes, sets, percent)

    def size_class(n: Column) -> Column:
        return F.floor(F.log(n) / F.log(F.lit(1.03))).cast("int")

    low = F.ceil(F.col("n") * percent / 100)
    rows = rows.withColumn("high", F.least("reach", "n"))
    asks = rows.where(F.col("high") >= low).withColumn("class", F.explode(F.sequence(size_class(low), size_class(F.col("high")))))
    answers = rows.where("reach >= n").withColumn("class", size_class(F.col("n")))
    asks, answers = stored(asks.drop("high"), "asks"), stored(answers.drop("high"), "answers")
    per_key = answers.groupBy("gram", "class", "label").agg(F.count("*").alias("rows"))
    main = per_key.groupBy("gram", "class").agg(F.max_by("label", F.struct("rows", "label")).alias("main"))
    asks, answers = asks.join(main, ["gram", "class"]), answers.join(main, ["gram", "class"])

    def dealt(rows: DataFrame, sizes: DataFrame, mine: str, other: str) -> DataFrame:
        """Rows with a cell of their key's grid: dealt by themselves in one direction, repeated along the other."""
        rows = rows.join(sizes, ["gram", "class"])
        rows = rows.withColumn(mine, F.pmod(F.xxhash64("node"), F.ceil(F.col(mine) / CELL)).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), (F.ceil(F.col(other) / CELL) - 1).cast("int"))))

    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        counted = [x.groupBy("gram", "class").agg(F.count("*").alias(side)) for x, side in ((a, "row"), (b, "column"))]
        sizes = stored(counted[0].join(counted[1], ["gram", "class"]), "grid")
        a, b = dealt(a, sizes, "row", "column"), dealt(b, sizes, "column", "row")
        a = a.select("row", "column", "gram", "class", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("label").alias("lx"), F.col("reach").alias("rx"))
        b = b.select("row", "column", "gram", "class", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("label").alias("ly"), F.col("reach").alias("ry"))
        fits = "lx <> ly and nx >= ny and ny <= rx and nx <= ry and ny * 100 >= nx * " + str(percent)
        return a.join(b, ["gram", "class", "row", "column"]).where(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    return meet(asks.where("label <> main"), answers).unionByName(meet(asks.where("label = main"), answers.where("label <> main"))).distinct()


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per document: `doc_id`, `n_shingles` (distinct shingles), `component_id` (smallest id reachable), `kept`.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets. Words are runs of anything but
    the space and characters 9 to 13, with A-Z lower-cased; a text shorter than a shingle is one shingle.

    Defined results: a null or blank text has 0 shingles and is linked with nothing. Repeated rows each give a row; rows
    that share an id but not their text are linked each by its own text. A row with a null id takes part like others, but
    gives no id; where no row of a component has one, its id is null (and all its rows count as kept). Other columns of
    `docs` are not read.
    """
    out = _grouped(docs, id_col, text_col, shingle, percent, bands, rows)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, bands: int, rows: int) -> DataFrame:
    """Per row: `doc_id`, `tk` (hash of the text), `n`, `component_id` and `label`, the component's number (null without shingles)."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tk"))
    signed = docs.mapInArrow(_sign(shingle, bands, rows), "doc_id long, tk long, n long, d1 long, d2 long, bands array<long>")
    signed = stored(signed, "signatures")
    # A class goes on with its smallest row, by id and text; copies add nothing to buckets.
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "tk")).alias("rep")
    classes = signed.where("n > 0").groupBy("d1", "d2").agg(smallest, F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = classes.select("d1", "d2", "n", "bands", F.col("rep.doc_id").alias("rep_id"), F.col("rep.tk").alias("rep_tk"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # the stored table fixes the numbers
    keys = classes.select("node", "n", F.col("rep_id").alias("rep"), F.posexplode("bands").alias("band", "key"))
    crowded = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    keys = stored(keys.join(crowded.select("key"), "key", "left_semi"), "keys")
    classes = classes.drop("bands", "n")
    wanted = classes.join(keys.select("node").distinct(), "node", "left_semi").select("node", "rep_id", "rep_tk")
    own = docs.doc_id.eqNullSafe(wanted.rep_id) & (docs.tk == wanted.rep_tk)
    sets = docs.join(wanted, own).select("node", "text").mapInArrow(_sets(shingle), "node long, grams array<long>")
    again = signed.where("n > 0").groupBy("doc_id", "tk").agg(F.count("*").alias("rows")).where("rows > 1")
    if not again.isEmpty():  # rows that are repeated as a whole would give their set more than once
        sets = sets.dropDuplicates(["node"])
    sets = stored(sets, "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those whose full sets are similar enough."""
        a = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
        b = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
        both = F.size(F.array_intersect("ga", "gb"))
        rows_ = pairs.join(a, "a").join(b, "b").select("a", "b", both.alias("i"), (F.size("ga") + F.size("gb")).alias("s"))
        return rows_.where(F.col("i") * 100 >= percent * (F.col("s") - F.col("i"))).select("a", "b")

    def similar_size(x: str, y: str):
        return (F.col(x) * 100 >= percent * F.col(y)) & (F.col(y) * 100 >= percent * F.col(x))

    def placed(rows_: DataFrame, labels: DataFrame | None) -> DataFrame:
        """Key rows with the component of their node."""
        if labels is None:
            return rows_.withColumn("label", F.col("node"))
        return rows_.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def mixed(rows_: DataFrame) -> DataFrame:
        """Key rows of buckets that still hold more than one component, with the bucket's hub."""
        # The smallest id: where copies were made of an older document, that is the one that all of them resemble.
        hub = F.min(F.struct(F.col("rep").isNull().alias("null"), "rep", "node", "n", "label")).alias("hub")
        open_ = rows_.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), hub)
        # As a table of its own, so that the join can split a bucket that very many share.
        return rows_.join(stored(open_.where("lo <> hi").select("key", "hub"), "open"), "key")

    labels = None
    for start, stop in ((0, 3), (3, 8)):
        part = mixed(placed(keys.where((F.col("band") >= start) & (F.col("band") < stop)), labels))
        part = part.where("label <> hub.label").select(F.col("node").alias("a"), "n", F.col("hub.node").alias("b"), F.col("hub.n").alias("m"))
        part = part.where(similar_size("n", "m")).select("a", "b").distinct()
        labels = contract(confirmed(part), labels)
    rest = mixed(placed(keys, labels)).select("key", "node", "n", "label")
    members = stored(rest.groupBy("key").agg(F.count("*").alias("crowd")), "members")
    rest = stored(rest.join(members, "key"), "rest")
    small = rest.where(F.col("crowd") <= CROWD)
    pairs = _both_ways(small, "key", similar_size)
    crowded = rest.where(F.col("crowd") > CROWD).select("node", "n", "label").distinct()
    pairs = pairs.unionByName(_prefix_pairs(crowded, sets, percent)).distinct()
    labels = contract(confirmed(pairs), labels)

    label = F.coalesce("label", "node") if labels is not None else F.col("node")
    classes = classes.join(labels, "node", "left") if labels is not None else classes
    classes = stored(classes.select("d1", "d2", "rep_id", label.alias("label")), "labelled")
    components = classes.groupBy("label").agg(F.min("rep_id").alias("component_id"))
    classes = classes.join(components, "label").select("d1", "d2", "label", "component_id")
    out = signed.select("doc_id", "tk", "n", "d1", "d2").join(classes, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "tk", "n", component.alias("component_id"), F.when(F.col("n") > 0, F.col("label")).alias("label"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` with one of each group of near-duplicates, with their columns whatever their names.

    Of a component, the row with the smallest id stays (any id before null, and of rows that share it, the one whose text
    has the smallest hash; of rows alike in both, the one whose other columns hash smallest). Ids are not told apart
    otherwise: rows with the same id and quite different texts all stay. A text without words is linked with nothing and
    stays.
    """
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    lower = [n.lower() for n in names]
    key, text = inner[lower.index(id_col.lower())], inner[lower.index(text_col.lower())]
    rows = docs.toDF(*inner)
    found = _grouped(rows, key, text, shingle, percent, BANDS, ROWS).where("label is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "tk")).alias("w")
    kept = found.groupBy("label").agg(first, F.count("*").alias("rows")).select("w.doc_id", "w.tk", "rows")
    kept = stored(kept.select(F.col("doc_id").alias("w_id"), F.col("tk").alias("w_tk"), "rows"), "kept")
    rows = rows.withColumns({"tk": F.xxhash64(text), "id": F.col(key).cast("long")})
    blank = rows.where(F.coalesce(~F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(True)))
    own = F.col("id").eqNullSafe(F.col("w_id")) & (F.col("tk") == F.col("w_tk"))
    stay = rows.join(kept, own).drop("w_id", "w_tk")
    # Only rows of larger components can be repeated as a whole.
    alike = W.partitionBy("id", "tk").orderBy(F.xxhash64(*inner))
    many = stay.where("rows > 1").withColumn("nth", F.row_number().over(alike)).where("nth = 1")
    return stay.where("rows = 1").select(*inner).unionByName(many.select(*inner)).unionByName(blank.select(*inner)).toDF(*names)

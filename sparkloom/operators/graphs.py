"""Closures and fixpoints over edge tables."""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; a session on one machine that sets none gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="sparkloom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/sparkloom"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read back, so that iterations do not pile up lineage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/round-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(target)
    return spark.read.schema(schema).parquet(path)


def _rounds(spark: SparkSession) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """A store for the rounds of an iteration: takes a round's rows, gives them back read, and all rounds so far.

    Rounds are files of one folder, so the plan over all of them is a single scan however many there are.
    """
    folder, paths = f"{scratch_dir(spark)}/rounds-{uuid.uuid4().hex}", []
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(target)

    def put(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        schema = df.schema
        paths.append(f"{folder}/{len(paths)}")
        df.write.parquet(paths[-1])
        read = spark.read.schema(schema)
        return read.parquet(paths[-1]), read.parquet(*paths)

    return put


def reachable(roots: DataFrame, edges: DataFrame, *, node: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """All nodes reachable from `roots`, with `depth` (fewest steps) and `parent` (the smallest predecessor at that depth).

    One join of the frontier per round; the driver sees only whether a frontier is empty. Cycles end by themselves.
    """
    put = _rounds(roots.sparkSession)
    edges = cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct())
    kind = edges.schema["src"].dataType
    first = roots.select(F.col(node).cast(kind).alias("node")).distinct()
    frontier, seen = put(first.withColumns({"depth": F.lit(0).cast("long"), "parent": F.lit(None).cast(kind)}))
    while not frontier.isEmpty():
        step = frontier.join(edges, frontier.node == edges.src).groupBy("dst").agg(F.min("src").alias("parent"), (F.min("depth") + 1).alias("depth"))
        step = step.select(F.col("dst").alias("node"), "depth", "parent")
        frontier, seen = put(step.join(seen.select("node"), "node", "left_anti"))
    return seen


def _squared(edges: DataFrame) -> tuple[DataFrame, int, int]:
    """Edges and the paths of two of them; and how many there are before and after. Tasks stay small however many."""
    before = edges.count()
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), before // 1_000_000 + 1)
    first = edges.select("src", F.col("dst").alias("mid")).repartition(parts, "mid").hint("merge")
    two = first.join(edges.select(F.col("src").alias("mid"), "dst").repartition(parts, "mid"), "mid").select("src", "dst")
    out = cut(edges.unionByName(two).repartition(parts, "src", "dst").distinct())
    return out, before, out.count()


def closure(roots: DataFrame, edges: DataFrame, *, hops: int = 4, patience: int = 32) -> DataFrame:
    """The nodes reachable from `roots`, of any type, without depths.

    After every `patience` rounds edges are squared, up to `hops` times and as long as that makes no more than four times
    as many as at first, so that one round takes many steps on graphs of long chains; what is near its roots never pays
    for that. A frontier may be broadcast, so each node is once at most; what was seen before never is.
    """
    put = _rounds(roots.sparkSession)
    edges = cut(edges.select("src", "dst"))
    frontier, seen = put(roots.select(F.col("node").cast(edges.schema["src"].dataType).alias("node")).distinct())
    done, most = 0, None
    while not frontier.isEmpty():
        if hops and done == patience:
            squared, before, after = _squared(edges)
            most = most or 4 * before
            edges, hops, done = (squared, hops - 1, 0) if after <= most else (edges, 0, 0)
        step = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct()
        frontier, seen = put(step.join(seen.hint("merge"), "node", "left_anti"))
        done += 1
    return seen


def alias_chain(links: DataFrame, *, name: str = "name", target: str = "target", final: str = "final") -> DataFrame:
    """Follows name -> target to the end: `state` resolved (at a `final` name), missing (at an unknown one) or cycle.

    `end` is the final or the unknown name, `steps` the links followed to it; of a cycle, `end` is its smallest name and
    `steps` is null. Names that nothing points to only take what their target has. As long as that leaves clearly fewer
    names they are put aside; the rest is solved by itself, and each layer then looks its targets up once.
    """
    layers = [cut(links.select(F.col(name).alias("n"), F.col(target).alias("t"), F.coalesce(F.col(final), F.lit(False)).alias("f")))]
    size = layers[0].count()
    while True:
        wanted = layers[-1].where("not f").select(F.col("t").alias("n")).distinct()
        inner = cut(layers[-1].join(wanted.hint("merge"), "n", "left_semi"))
        left = inner.count()
        if not left or left > 0.7 * size:
            break
        layers.append(inner)
        size = left
    out = _doubled(layers.pop())
    while layers:
        ends = cut(out).select(F.col("name").alias("t"), F.col("state").alias("then"), F.col("end").alias("far"), F.col("steps").alias("more"))
        final_, lost = F.col("f"), F.col("then").isNull()
        out = layers.pop().join(ends.hint("merge"), "t", "left").select(
            F.col("n").alias("name"), F.when(final_, "resolved").when(lost, "missing").otherwise(F.col("then")).alias("state"),
            F.when(final_, F.col("n")).when(lost, F.col("t")).otherwise(F.col("far")).alias("end"), F.when(final_, 0).when(lost, 1).otherwise(F.col("more") + 1).cast("long").alias("steps"),
        )
    return out


def _doubled(known: DataFrame) -> DataFrame:
    """What `alias_chain` gives, for links `n`, `t`, `f`.

    All chains jump at once and double their reach every round. Where a round settles none, a chain that is still open has
    no end: the rounds then go on until each jump spans all open names, and the smallest name within the span of a jump's
    end is that of its cycle. So the rounds are logarithmic in the longest chain, and there is no cap.
    """
    ends = known.select(F.col("n").alias("t"), F.lit(True).alias("there"))
    state = F.when(F.col("f"), "resolved").when(F.col("there").isNull(), "missing")
    end = F.when(F.col("f"), F.col("n")).otherwise(F.col("t"))
    jumps = known.join(ends.hint("merge"), "t", "left").select(F.col("n").alias("name"), end.alias("end"), F.when(F.col("f"), 0).otherwise(1).cast("long").alias("steps"), state.alias("state"), F.col("n").alias("low"))
    put = _rounds(known.sparkSession)
    now, every = put(jumps)
    left, span, closing = None, 1, False
    while True:
        # A round holds the names that were open before it; those that it settled are in no later one.
        settled, open_ = every.where("state is not null").drop("low"), now.where("state is null").drop("state")
        before, left = left, open_.count()
        closing = closing or left == before
        if not left or (closing and span >= left):
            break
        then = F.lit(None).cast("string") if closing else F.col("state")
        far = open_ if closing else settled.withColumn("low", F.col("name")).unionByName(open_.withColumn("state", F.lit(None).cast("string")))
        far = far.select(F.col("name").alias("end"), F.col("end").alias("far"), F.col("steps").alias("more"), then.alias("then"), F.col("low").alias("lower"))
        step = open_.join(far.hint("merge"), "end").select("name", F.col("far").alias("end"), (F.col("steps") + F.col("more")).alias("steps"), F.col("then").alias("state"), F.least("low", "lower").alias("low"))
        now, every = put(step)
        span *= 2
    lows = open_.select(F.col("name").alias("end"), "low")
    cyclic = open_.drop("low").join(lows, "end").select("name", F.lit("cycle").alias("state"), F.col("low").alias("end"), F.lit(None).cast("long").alias("steps"))
    return settled.select("name", "state", "end", "steps").unionByName(cyclic)


def flatten_tree(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, node, depth) for every node below each root; a node met twice under a root counts at its least depth.

    Levels go on until one finds nothing new, which cycles cannot prevent.
    """
    put = _rounds(roots.sparkSession)
    edges = cut(edges.select("src", "dst").distinct())
    level, out = put(roots.select(F.col("node").alias("root"), "node", F.lit(0).cast("long").alias("depth")))
    depth = 0
    while not level.isEmpty():
        depth += 1
        level = level.join(edges, level.node == edges.src).select("root", F.col("dst").alias("node")).distinct()
        level, out = put(level.join(out.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth).cast("long")))
    return out


def settle(nodes: list, entries: dict, edges: list[tuple], rounds: int | None = 1000) -> tuple[dict, bool]:
    """Depths of a graph's nodes: {node: (depth or None, conflict)}, and whether the rounds came to rest.

    All nodes that can be settled in a round are settled together, once for all. A node waits for all of its predecessors;
    when nothing moves any more, those that never settle count as dead, and the others decide. Known depths that disagree
    are a conflict and make the depth unknown, and so does an unknown predecessor. A round looks only at what follows the
    nodes of the round before; `rounds` None goes on until it comes to rest.
    """
    before: dict = {n: [] for n in nodes}
    after: dict = {n: [] for n in nodes}
    for src, dst, delta in edges:
        before[dst].append((src, delta))
        after[src].append(dst)
    state = {n: (d, False) for n, d in entries.items()}
    missing = {n: len(before[n]) for n in nodes}
    moved, relaxed, reached = list(state), False, set()
    for _ in itertools.count() if rounds is None else range(rounds):
        for n in moved:
            for to in after[n]:
                missing[to] -= 1
                if to not in state:
                    reached.add(to)
        new = {}
        for n in list(reached) if relaxed else [n for n in reached if not missing[n]]:
            sent = [(state[p], delta) for p, delta in before[n] if p in state]
            known = {depth + delta for (depth, _), delta in sent if depth is not None and delta is not None}
            vague = any(depth is None or delta is None for (depth, _), delta in sent)
            new[n] = (None if vague or len(known) > 1 else next(iter(known)), len(known) > 1)
        moved = list(new)
        if new:
            state |= new
            reached -= new.keys()
        elif relaxed:
            return state, True
        else:
            relaxed = True
    return state, False


def depth_fixpoint(nodes: DataFrame, edges: DataFrame, *, rounds: int | None = 1000) -> DataFrame:
    """Stack depth at the entry of every node of many small graphs: `block`, `node`, `depth`, `conflict`, `settled`.

    `nodes` holds `block`, `node` and, for entries, a `depth` (else null); `edges` holds `block`, `src`, `dst` and `delta`
    (null if unknown). See `settle` for the rule. Nodes that never settle are dead: `depth` null and `settled` false, as
    for all nodes still open where `rounds` run out (None: never). A graph streams through one task; graphs are spread over
    all.
    """
    none = F.lit(None).cast("long")
    rows = nodes.select("block", F.col("node").alias("a"), none.alias("b"), F.col("depth").cast("long").alias("x"))
    rows = rows.unionByName(edges.select("block", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("delta").cast("long").alias("x")))
    rows = rows.selectExpr("CAST(block AS bigint) AS block", "CAST(a AS bigint) AS a", "CAST(b AS bigint) AS b", "x")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(block: int, part: list[tuple]) -> pa.RecordBatch:
            own = [a for a, b, _ in part if b is None]
            inside = set(own)
            state, _ = settle(own, {a: x for a, b, x in part if b is None and x is not None}, [(a, b, x) for a, b, x in part if b is not None and a in inside and b in inside], rounds)
            got = [state.get(n) for n in own]
            columns = [[block] * len(own), own, [g and g[0] for g in got], [bool(g and g[1]) for g in got], [g is not None for g in got]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "node", "depth", "conflict", "settled"])

        last, part = None, []
        for batch in batches:
            for block, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part and block != last:
                    yield solved(last, part)
                    part = []
                last = block
                part.append(row)
        if part:
            yield solved(last, part)

    # By a hash of the block: a union of tables that lie by block already counts as dealt by block, and Spark drops the
    # exchange; the two sides are then coalesced on their own, and a graph's nodes and edges come to different tasks.
    rows = rows.repartition(parts, F.xxhash64("block")).sortWithinPartitions("block", "b", "a")
    return rows.mapInArrow(run, "block long, node long, depth long, conflict boolean, settled boolean")


def hop_depths(edges: DataFrame) -> DataFrame:
    """Outgoing edges of every node in order, as rows (src, dst, n)."""
    return edges.withColumn("n", F.row_number().over(W.partitionBy("src").orderBy("dst")))

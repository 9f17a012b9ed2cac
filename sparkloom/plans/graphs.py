"""Closures and fixpoints: parts as a cyclic graph, the geography and its orders as a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import graphs as g
from sparkloom.plans.registry import Tables, query
from sparkloom.plans.timeline import ROWS, rows

_N = "(SELECT count(*) FROM part)"
_EDGES = f"(SELECT p_partkey AS src, (7 * p_partkey + 1) % {_N} AS dst FROM part UNION SELECT p_partkey, (p_partkey * 3) % {_N} FROM part WHERE p_size % 5 = 0)"
_CLOSURE = f"""WITH RECURSIVE e AS (SELECT * FROM {_EDGES}), c(node) AS (SELECT p_partkey FROM part WHERE p_partkey % 97 = 1 UNION SELECT e.dst FROM c JOIN e ON e.src = c.node)"""


def edges(t: Tables) -> DataFrame:
    p, n = t.part, t.part.agg(F.count("*").alias("n"))
    p = p.select("p_partkey", "p_size").crossJoin(F.broadcast(n))
    a = p.select(F.col("p_partkey").alias("src"), ((7 * F.col("p_partkey") + 1) % F.col("n")).alias("dst"))
    return a.unionByName(p.where("p_size % 5 = 0").select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 3) % F.col("n")).alias("dst")))


def roots(t: Tables) -> DataFrame:
    return t.part.where("p_partkey % 97 = 1").select(F.col("p_partkey").alias("node"))


@query(f"{_CLOSURE} SELECT node FROM c")
def reachability(t: Tables) -> DataFrame:
    """Everything reachable from the roots, through cycles."""
    return g.closure(roots(t), edges(t))


@query(
    f"""{_CLOSURE}, gate AS (SELECT bool_or(p_size = 50) AS incomplete FROM c JOIN part ON p_partkey = node)
    SELECT p_partkey AS node, CASE WHEN p_partkey IN (SELECT node FROM c) THEN 'reachable' WHEN (SELECT incomplete FROM gate) THEN 'kept' ELSE 'prunable' END AS verdict FROM part"""
)
def prune_verdict(t: Tables) -> DataFrame:
    """What may go: nothing, if any reachable node was read incompletely."""
    seen = g.closure(roots(t), edges(t)).select("node", F.lit(True).alias("seen"))
    p = t.part.select(F.col("p_partkey").alias("node"), "p_size").join(seen, "node", "left")
    gate = p.where("seen").agg(F.coalesce(F.bool_or(F.col("p_size") == 50), F.lit(False)).alias("incomplete"))
    return p.crossJoin(F.broadcast(gate)).select("node", F.when(F.col("seen"), "reachable").when(F.col("incomplete"), "kept").otherwise("prunable").alias("verdict"))


_FLOW = f"(SELECT timeline, idx, lead(idx) OVER (PARTITION BY timeline ORDER BY idx) AS next, kind, character FROM {ROWS})"


def flow(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    nxt = F.lead("idx").over(W.partitionBy("timeline").orderBy("idx"))
    return rows(t).select("timeline", "idx", nxt.alias("next"), "kind", "character")


_CFG = f"(SELECT idx AS src, next AS dst FROM {_FLOW} WHERE next IS NOT NULL AND kind NOT IN ('error', 'purchase') UNION SELECT f.idx, f.idx + 40 FROM {_FLOW} f JOIN events v ON v.event_id = f.idx + 40 WHERE f.kind IN ('error', 'click'))"


def flow_edges(t: Tables) -> DataFrame:
    f = flow(t)
    falls = f.where("next is not null and kind not in ('error', 'purchase')").select(F.col("idx").alias("src"), F.col("next").alias("dst"))
    jumps = f.where("kind in ('error', 'click')").select(F.col("idx").alias("src"), (F.col("idx") + 40).alias("dst"))
    return falls.unionByName(jumps.join(f.select(F.col("idx").alias("dst")), "dst", "left_semi").select("src", "dst"))


@query(f"WITH RECURSIVE e AS (SELECT * FROM {_CFG}), c(node) AS (SELECT event_id FROM events WHERE event_id < 5 UNION SELECT e.dst FROM c JOIN e ON e.src = c.node) SELECT event_id AS node, event_id IN (SELECT node FROM c) AS reachable FROM events")
def cfg_reachability(t: Tables) -> DataFrame:
    """Blocks that control flow can reach; the others stay, flagged."""
    entry = t.events.where("event_id < 5").select(F.col("event_id").alias("node"))
    seen = g.closure(entry, flow_edges(t)).select("node", F.lit(True).alias("seen"))
    return t.events.select(F.col("event_id").alias("node")).join(seen, "node", "left").select("node", F.coalesce("seen", F.lit(False)).alias("reachable"))


@query(
    f"""SELECT f.idx, f.idx + f.character - 20 AS target, t.event_id IS NOT NULL AS valid FROM {_FLOW} f LEFT JOIN events t ON t.event_id = f.idx + f.character - 20
    AND t.user_id = f.timeline WHERE f.kind = 'click'"""
)
def branch_targets(t: Tables) -> DataFrame:
    """Branch targets, and whether they hit a record of their own block."""
    f = flow(t)
    b = f.where("kind = 'click'").select("timeline", "idx", (F.col("idx") + F.col("character") - 20).alias("target"))
    at = f.select("timeline", F.col("idx").alias("target"), F.lit(True).alias("hit"))
    return b.join(at, ["timeline", "target"], "left").select("idx", "target", F.col("hit").isNotNull().alias("valid"))


@query(f"SELECT dst AS node, count(*) AS predecessors, min(src) AS first_src FROM {_CFG} GROUP BY ALL")
def edge_explode(t: Tables) -> DataFrame:
    """Predecessors of each block, from the targets of terminators."""
    return flow_edges(t).distinct().groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("predecessors"), F.min("src").alias("first_src"))


_STEPS = f"""(SELECT timeline AS block, row_number() OVER (PARTITION BY timeline ORDER BY idx) AS node, kind, character FROM {ROWS})"""


@query(
    f"""WITH RECURSIVE n AS MATERIALIZED (SELECT * FROM {_STEPS}),
    e AS MATERIALIZED (SELECT a.block, a.node AS src, b.node AS dst, a.character % 2 AS delta FROM n a JOIN n b ON b.block = a.block AND (b.node = a.node + 1 OR (a.kind IN ('error', 'click') AND b.node = a.node + 4))),
    r(block, node, depth) AS (SELECT block, node, CAST(0 AS BIGINT) FROM n WHERE node = 1 UNION SELECT e.block, e.dst, r.depth + e.delta FROM r JOIN e ON e.block = r.block AND e.src = r.node),
    k AS (SELECT block, node, max(depth) AS depth FROM r GROUP BY ALL HAVING min(depth) = max(depth)),
    c AS (SELECT e.block, e.dst AS node, count(DISTINCT k.depth + e.delta) > 1 AS conflict FROM e JOIN k ON k.block = e.block AND k.node = e.src GROUP BY ALL)
    SELECT n.block, n.node, k.depth, coalesce(c.conflict, false) AS conflict FROM n LEFT JOIN k USING (block, node) LEFT JOIN c USING (block, node)"""
)
def depth_fixpoint(t: Tables) -> DataFrame:
    """Stack depth at every record of each timeline, from its first on; predecessors that disagree make it unknown.

    The oracle walks all paths: a depth is known where all of them give one. Tests hold loops and dead code against plain
    rounds.
    """
    from pyspark.sql import Window as W

    n = rows(t).withColumn("node", F.row_number().over(W.partitionBy("timeline").orderBy("idx")).cast("long"))
    jumps = F.when(F.col("kind").isin("error", "click"), F.array(F.col("node") + 1, F.col("node") + 4)).otherwise(F.array(F.col("node") + 1))
    e = n.select(F.col("timeline").alias("block"), F.col("node").alias("src"), F.explode(jumps).alias("dst"), (F.col("character") % 2).alias("delta"))
    start = n.select(F.col("timeline").alias("block"), "node", F.when(F.col("node") == 1, 0).alias("depth"))
    return g.depth_fixpoint(start, e, rounds=None).select("block", "node", "depth", "conflict")


_LINKS = "(SELECT o_orderkey AS name, (o_orderkey * 3 + 7) % (SELECT max(o_orderkey) + 1 FROM orders) AS target, o_orderkey % 50 = 0 AS final FROM orders)"


@query(
    f"""WITH RECURSIVE k AS MATERIALIZED (SELECT * FROM {_LINKS}),
    c(name, cur, steps) AS (SELECT name, name, CAST(0 AS BIGINT) FROM k WHERE final
      UNION ALL SELECT k.name, c.cur, c.steps + 1 FROM c JOIN k ON k.target = c.name AND NOT k.final),
    m(name, cur, steps) AS (SELECT name, target, CAST(1 AS BIGINT) FROM k WHERE NOT final AND target NOT IN (SELECT name FROM k)
      UNION ALL SELECT k.name, m.cur, m.steps + 1 FROM m JOIN k ON k.target = m.name AND NOT k.final),
    o AS MATERIALIZED (SELECT name, target FROM k WHERE name NOT IN (SELECT name FROM c) AND name NOT IN (SELECT name FROM m)),
    w(name, cur) AS (SELECT name, target FROM o UNION SELECT w.name, o.target FROM w JOIN o ON o.name = w.cur),
    y AS (SELECT w.name, min(w.cur) AS "end" FROM w WHERE EXISTS (SELECT 1 FROM w v WHERE v.name = w.cur AND v.cur = w.cur) GROUP BY ALL)
    SELECT name, 'resolved' AS state, cur AS "end", steps FROM c UNION ALL SELECT name, 'missing', cur, steps FROM m UNION ALL SELECT name, 'cycle', "end", NULL FROM y"""
)
def alias_chain(t: Tables) -> DataFrame:
    """Aliases followed to what they stand for: resolved, missing or cyclic. The oracle walks backwards from the ends."""
    k = F.col("o_orderkey")
    size = F.broadcast(t.orders.agg((F.max(k) + 1).alias("size")))  # one row
    links = t.orders.select("o_orderkey").crossJoin(size).select(k.alias("name"), ((k * 3 + 7) % F.col("size")).alias("target"), (k % 50 == 0).alias("final"))
    return g.alias_chain(links).select("name", "state", "end", "steps")


_TREE = """(SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"""


def tree(t: Tables) -> DataFrame:
    a = t.nation.select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("src"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("dst"))
    return a.unionByName(t.customer.select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("src"), F.concat(F.lit("c"), F.col("c_custkey")).alias("dst")))


@query(
    f"""WITH RECURSIVE e AS (SELECT * FROM {_TREE}), f(root, node, depth) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region
    UNION ALL SELECT f.root, e.dst, f.depth + 1 FROM f JOIN e ON e.src = f.node) SELECT root, node, min(depth) AS depth FROM f GROUP BY ALL"""
)
def tree_flatten(t: Tables) -> DataFrame:
    """Every node under each root, with its depth."""
    r = t.region.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("node"))
    return g.flatten_tree(r, tree(t)).select("root", "node", "depth")


@query(
    f"""WITH RECURSIVE e AS (SELECT src, dst, CAST(length(dst) AS BIGINT) AS x, 5 + length(src) AS frames FROM {_TREE}),
    f(node, level, started, x) AS (SELECT 'r' || r_regionkey, 0, CAST(r_regionkey AS BIGINT), CAST(0 AS BIGINT) FROM region
      UNION ALL SELECT e.dst, f.level + 1, (100 - f.started) % e.frames, f.x * 2 + e.x FROM f JOIN e ON e.src = f.node WHERE f.level < 32)
    SELECT node, level, started AS playhead, x FROM f"""
)
def nested_playhead(t: Tables) -> DataFrame:
    """Playheads and composed offsets down a nesting of timelines: each level wraps by its own length."""
    level = t.region.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("node"), F.lit(0).alias("level"), F.col("r_regionkey").cast("long").alias("playhead"), F.lit(0).cast("long").alias("x"))
    e = g.cut(tree(t).withColumns({"dx": F.length("dst").cast("long"), "frames": F.length("src") + 5}))
    out = level
    for _ in range(32):
        level = level.join(e, level.node == e.src).select(
            F.col("dst").alias("node"), F.col("level") + 1, F.pmod(100 - F.col("playhead"), F.col("frames")).alias("playhead"), (F.col("x") * 2 + F.col("dx")).alias("x")
        )
        level = g.cut(level.toDF("node", "level", "playhead", "x"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


@query("SELECT DISTINCT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey * 7 + 3) % 25 WHERE a.n_regionkey < b.n_regionkey")
def wrong_direction(t: Tables) -> DataFrame:
    """Dependencies that point from an earlier phase to a later one."""
    a = t.nation.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("phase"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("dst"))
    b = t.nation.select(F.col("n_nationkey").alias("dst"), F.col("n_regionkey").alias("later"))
    return a.join(b, "dst").where("phase < later").select("src", "dst").distinct()

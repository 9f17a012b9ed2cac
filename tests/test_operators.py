"""Operators against plain Python on small seeded inputs, with the edge cases that the queries do not reach."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import folds, graphs, joins, ordered, sorting
from sparkloom.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_segment_numberings_differ_after_the_first_marker(spark):
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate("aSbSc")], "t long, i long, k string")
    marker = F.col("k") == "S"
    assert [r.frame for r in ordered.segment(df, ["t"], ["i"], marker).orderBy("i").collect()] == [0, 0, 1, 1, 2]
    assert [r.frame for r in ordered.segment_lagging(df, ["t"], ["i"], marker).orderBy("i").collect()] == [0, 0, 0, 1, 1]


def test_fold_equals_a_sequential_fold(spark):
    rnd = random.Random(5)
    data = [(t, i, rnd.randrange(4), rnd.choice(["place", "place", "move", "remove"]), rnd.choice([None, rnd.randrange(50)]), rnd.choice([None, rnd.randrange(9)])) for t in range(3) for i in range(80)]
    df = spark.createDataFrame(data, "t long, i long, d long, k string, c long, p long")
    held = {}
    for t, _, d, k, c, p in data:
        if k == "remove":
            held.pop((t, d), None)
        else:
            old = held.get((t, d), (None, None))
            held[t, d] = (c if c is not None else old[0], p if p is not None else old[1])
    got = folds.fold_slots(df, ["t"], "d", ["i"], F.col("k") == "remove", ["c", "p"]).select("t", "d", "c", "p")
    assert {(r.t, r.d): (r.c, r.p) for r in got.collect()} == held


def test_snapshots_equal_a_replay(spark):
    rnd = random.Random(9)
    data = [(i, i // 4, rnd.randrange(3), rnd.choice(["place", "remove", "place"]), rnd.randrange(50)) for i in range(60)]
    df = spark.createDataFrame([(1, *r) for r in data], "t long, i long, f long, d long, k string, c long")
    want, held = set(), {}
    for i, f, d, k, c in data:
        if k == "remove":
            held.pop(d, None)
        else:
            held[d] = (c, held[d][1] if d in held else f)
        if i % 4 == 3:
            want |= {(f, s, x, since) for s, (x, since) in held.items()}
    got = folds.snapshots(df, ["t"], "f", "d", ["i"], F.col("k") == "remove", ["c"])
    assert {(r.f, r.d, r.c, r.since) for r in got.collect()} == want


def test_removal_by_character_query(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet").orderBy("event_id").collect()
    want = {}
    for e in events:
        held, depth, c = want.setdefault(e.user_id, {}), e.event_id % 5, int(e.value // 1)
        if e.event_type == "signup":
            held[depth] = c
        elif e.event_type == "error" and depth in held and (c % 2 == 0 or held[depth] == c):
            del held[depth]
    got = QUERIES["removal_by_character"](spark, FOLDER).collect()
    assert {(r.timeline, r.slot): r.character for r in got} == {(t, s): c for t, h in want.items() for s, c in h.items()}


@pytest.mark.parametrize("seed", range(3))
def test_reachability_with_cycles(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(30), rnd.randrange(30)) for _ in range(35)]
    depth, frontier = {0: 0, 7: 0}, {0, 7}
    while frontier:
        frontier = {b for a, b in edges if a in frontier and b not in depth}
        depth |= dict.fromkeys(frontier, 1 + max(depth.values()))
    got = graphs.reachable(spark.createDataFrame([(0,), (7,)], "node long"), spark.createDataFrame(edges, "src long, dst long"))
    assert {r.node: r.depth for r in got.collect()} == depth
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + edges, "src long, dst long")
    every = graphs.closure(spark.createDataFrame([(0,)], "node long"), chain)
    assert sorted(r.node for r in every.collect()) == list(range(41))


def test_closures_square_edges_only_on_long_ways(spark, monkeypatch):
    calls, squared = [], graphs._squared
    monkeypatch.setattr(graphs, "_squared", lambda e: calls.append(1) or squared(e))
    root = spark.createDataFrame([(0,)], "node long")
    chain = spark.createDataFrame([(i, i + 1) for i in range(14)] + [(14, 3), (50, 51)], "src long, dst long")
    assert sorted(r.node for r in graphs.closure(root, chain, patience=3).collect()) == list(range(15)) and len(calls) >= 2
    calls.clear()
    near = spark.createDataFrame([(0, 1), (1, 2), (2, 0), *((i, i + 1) for i in range(10, 60))], "src long, dst long")
    assert sorted(r.node for r in graphs.closure(root, near).collect()) == [0, 1, 2] and not calls


def test_what_closures_have_seen_is_not_broadcast(spark):
    """Only frontiers are: the plan of a later round merges with all that was seen."""
    plans, put = [], graphs._rounds

    def kept(session):
        store = put(session)
        return lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or store(df)

    graphs._rounds = kept
    try:
        graphs.closure(spark.range(1).toDF("node"), spark.range(4).selectExpr("id AS src", "id + 1 AS dst")).collect()
    finally:
        graphs._rounds = put
    assert len(plans) > 2 and all("SortMergeJoin" in p and "LeftAnti" in p for p in plans[1:])


def plain_rounds(nodes, entry, edges):
    """Depths round by round: all predecessors must be settled; once that gets no further, one is enough."""
    state, strict = {n: (d, False) for n, d in entry.items()}, True
    while True:
        new = {}
        for n in nodes:
            sources = [(a, x) for a, b, x in edges if b == n]
            ready = [(state[a][0], x) for a, x in sources if a in state]
            if n in state or not ready or (strict and len(ready) != len(sources)):
                continue
            values = {d + x for d, x in ready if d is not None and x is not None}
            unknown = len(values) != 1 or any(d is None or x is None for d, x in ready)
            new[n] = (None if unknown else min(values), len(values) > 1)
        if not new and not strict:
            return state
        strict = strict and bool(new)
        state.update(new)


@pytest.mark.parametrize("seed", range(3))
def test_depth_fixpoint_equals_plain_rounds(spark, seed):
    rnd = random.Random(seed)
    nodes, edges, want = [], [], {}
    for block in range(12):
        size = rnd.randrange(1, 14)
        own = sorted({(rnd.randrange(size), rnd.randrange(size)) for _ in range(size + 2)})
        own = [(a, b, rnd.choice([0, 0, 1, -1, None])) for a, b in own]
        nodes += [(block, n, 0 if n == 0 else None) for n in range(size)]
        edges += [(block, *e) for e in own]
        state = plain_rounds(range(size), {0: 0}, own)
        want |= {(block, n): (*state.get(n, (None, False)), n in state) for n in range(size)}
    df = spark.createDataFrame(nodes, "block long, node long, depth long"), spark.createDataFrame(edges, "block long, src long, dst long, delta long")
    assert {(r.block, r.node): (r.depth, r.conflict, r.settled) for r in graphs.depth_fixpoint(*df).collect()} == want


def test_dead_predecessors_do_not_hold_a_join():
    state, rest = graphs.settle([0, 1, 2, 3], {0: 0}, [(0, 1, 2), (3, 1, 5), (1, 2, -1)])
    assert rest and state == {0: (0, False), 1: (2, False), 2: (1, False)}
    loop, _ = graphs.settle([0, 1, 2], {0: 0}, [(0, 1, 0), (1, 2, 1), (2, 1, 0)])
    assert loop == {0: (0, False), 1: (0, False), 2: (1, False)}  # the entry settles a loop's head before its back edge does
    chain = [(i, i + 1, 1) for i in range(1500)]
    assert graphs.settle(list(range(1501)), {0: 0}, chain)[1] is False and len(graphs.settle(list(range(1501)), {0: 0}, chain, 2000)[0]) == 1501


def test_long_graphs_settle_whole():
    nodes, chain = list(range(3001)), [(i, i + 1, 1) for i in range(3000)]
    state, rest = graphs.settle(nodes, {0: 0}, chain, None)
    assert rest and state == {n: (n, False) for n in nodes}


def test_graphs_stay_whole_where_nodes_and_edges_lie_by_block(spark):
    """Both sides are dealt by block before they meet, and coalesced to different numbers of tasks."""
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst", "spark.sql.adaptive.coalescePartitions.minPartitionSize")}
    for k, v in zip(held, ("16", "30000", "false", "1000"), strict=True):
        spark.conf.set(k, v)
    try:
        n = spark.range(6000).selectExpr("id % 300 AS block", "id DIV 300 AS node", "uuid() AS wide")
        w = Window.partitionBy("block").orderBy("node")
        nodes = n.withColumn("k", F.row_number().over(w)).selectExpr("block", "node", "CASE WHEN k = 1 THEN 0 END AS depth")
        edges = n.withColumn("k", F.row_number().over(w)).where("node < 19").selectExpr("block", "node AS src", "node + 1 AS dst", "k - node + length(wide) - 36 AS delta")
        got = graphs.depth_fixpoint(nodes, edges).where("depth = node AND settled").count()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == 6000


def test_alias_chain_states(spark):
    links = [("a", "b", False), ("b", "c", False), ("c", None, True), ("x", "y", False), ("y", "x", False), ("m", "gone", False), ("t1", "t2", False), ("t2", "y", False), ("s", "s", False), ("f", "s", True)]
    got = {r.name: (r.state, r.end, r.steps) for r in graphs.alias_chain(spark.createDataFrame(links, "name string, target string, final boolean")).collect()}
    assert got["a"] == ("resolved", "c", 2) and got["c"] == ("resolved", "c", 0) and got["f"] == ("resolved", "f", 0) and len(got) == len(links)
    assert all(got[n] == ("cycle", "x", None) for n in ("x", "y", "t1", "t2")) and got["s"] == ("cycle", "s", None) and got["m"] == ("missing", "gone", 1)


def test_long_alias_chains_and_cycles(spark):
    links = [(i, i + 1, i == 70) for i in range(71)] + [(100 + i, 100 + (i + 1) % 23, False) for i in range(23)] + [(200 + i, 201 + i, False) for i in range(9)] + [(209, 110, False)]
    got = {r.name: (r.state, r.end, r.steps) for r in graphs.alias_chain(spark.createDataFrame(links, "name long, target long, final boolean")).collect()}
    assert all(got[i] == ("resolved", 70, 70 - i) for i in range(71)) and all(got[i] == ("cycle", 100, None) for i in [*range(100, 123), *range(200, 210)])
    assert len(got) == len(links)


def test_alias_names_that_nothing_points_to_are_put_aside(spark, monkeypatch):
    """Three layers of leaves over a core of chains, a cycle and lost names: only the core is doubled."""
    links = [(i, i // 3, i == 0) for i in range(81)] + [(100, 101, False), (101, 100, False), (102, 101, False), (103, 102, False), (200, 999, False), (201, 200, True), (202, 201, False), (203, None, False)]
    sizes, doubled = [], graphs._doubled
    monkeypatch.setattr(graphs, "_doubled", lambda k: sizes.append(k.count()) or doubled(k))
    got = {r.name: (r.state, r.end, r.steps) for r in graphs.alias_chain(spark.createDataFrame(links, "name long, target long, final boolean")).collect()}

    def steps(i):
        return 0 if i == 0 else 1 + steps(i // 3)

    assert all(got[i] == ("resolved", 0, steps(i)) for i in range(81)) and len(got) == len(links) and sizes[0] < 20
    assert all(got[i] == ("cycle", 100, None) for i in range(100, 104)) and got[200] == ("missing", 999, 1) and got[203] == ("missing", None, 1)
    assert got[201] == ("resolved", 201, 0) and got[202] == ("resolved", 201, 1)


def test_deep_trees_are_flattened_whole(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(45)] + [(10, 5)], "src long, dst long")
    got = {r.node: r.depth for r in graphs.flatten_tree(spark.createDataFrame([(0,)], "node long"), edges).collect()}
    assert got == {i: i for i in range(46)}


def test_boxes_that_touch_do_not_overlap(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 10, 10), (2, 10, 0, 20, 10), (3, 5, 5, 15, 15), (4, 7, 7, 7, 9)], "id long, x0 long, y0 long, x1 long, y1 long")
    assert rows(joins.overlapping_boxes(boxes, "id", 4)) == [(1, 3), (2, 3)]


def crowded(n, corners, seed):
    """Boxes of which many share a lower corner, none empty: (id, x0, y0, x1, y1)."""
    rnd = random.Random(seed)
    places = [(rnd.randrange(-40, 40), rnd.randrange(-40, 40)) for _ in range(corners)]
    return [(i, x, y, x + rnd.randrange(1, 20), y + rnd.randrange(1, 20)) for i in range(n) for x, y in [rnd.choice(places)]]


BOX = "id long, x0 long, y0 long, x1 long, y1 long"


def overlaps(boxes):
    return sorted((p[0], q[0]) for p in boxes for q in boxes if p[0] < q[0] and p[1] < q[3] and q[1] < p[3] and p[2] < q[4] and q[2] < p[4])


@pytest.mark.parametrize("corners", [1, 12, 400])
def test_boxes_with_one_corner_meet_in_blocks(spark, monkeypatch, corners):
    monkeypatch.setattr(joins, "BLOCK_BOXES", 3, raising=False)
    monkeypatch.setattr(joins, "TASK_BOXES", 40, raising=False)
    boxes = crowded(150, corners, 5)
    boxes += boxes[:9]  # ids that come twice
    odd = [(200, 0, 0, 0, 5), (201, 3, 9, 7, 9), (None, -40, -40, 40, 40), (202, None, 0, 9, 9), (203, 0, 0, None, 9)]
    assert rows(joins.overlapping_boxes(spark.createDataFrame(boxes + odd, BOX), "id", 8)) == overlaps(boxes)


def test_pairs_of_boxes_are_written_in_few_bytes(spark, tmp_path):
    boxes = crowded(3000, 60, 7)
    pairs = joins.overlapping_boxes(spark.createDataFrame(boxes, BOX), "id", 20)
    pairs.write.parquet(str(tmp_path / "pairs"))
    out = spark.read.parquet(str(tmp_path / "pairs"))
    assert rows(out) == overlaps(boxes)
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.85 * out.count()


def test_contained_over_bucket_borders(spark):
    points = spark.createDataFrame([(i,) for i in range(-3, 25)], "p long")
    ranges = spark.createDataFrame([(1, -2, 9), (2, 8, 8), (3, 7, 20)], "id long, lo long, hi long")
    got = rows(joins.contained(points, "p", ranges, "lo", "hi").select("p", "id"))
    assert got == sorted((p, i) for p in range(-3, 25) for i, lo, hi in ((1, -2, 9), (3, 7, 20)) if lo <= p < hi)


def test_ranges_of_any_length_take_two_buckets_at_most(spark):
    rnd = random.Random(3)
    spans = [(i, lo, lo + rnd.choice([1, 2, 3, 64, 10**6, 10**12])) for i, lo in enumerate(rnd.randrange(-(10**12), 10**12) for _ in range(60))] + [(99, 0, 2**62)]
    places = [rnd.randrange(-(10**12), 10**12) for _ in range(80)] + [x + d for _, lo, hi in spans for x, d in ((lo, -1), (lo, 0), (hi, -1), (hi, 0))]
    points, ranges = spark.createDataFrame([(p,) for p in set(places)], "p long"), spark.createDataFrame(spans, "id long, lo long, hi long")
    _, spread = joins.range_buckets(points, "p", ranges, "lo", "hi")
    assert spread.count() <= 2 * len(spans)
    assert rows(joins.contained(points, "p", ranges, "lo", "hi").select("p", "id")) == sorted((p, i) for p in set(places) for i, lo, hi in spans if lo <= p < hi)


def test_row_numbers_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert [(r.k, r.n) for r in sorting.number_rows(df, ["k"]).orderBy("n").collect()] == [(i, i + 1) for i in range(1000)]


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "t long, i long, k string, c long, d long")
    assert ordered.segment(empty, ["t"], ["i"], F.col("k") == "S").count() == 0
    assert folds.fold_slots(empty, ["t"], "d", ["i"], F.col("k") == "r", ["c"]).count() == 0
    assert sorting.number_rows(empty, ["i"]).count() == 0
    none = spark.createDataFrame([], "src long, dst long")
    assert graphs.reachable(spark.createDataFrame([(1,)], "node long"), none).count() == 1

"""Mixing sources to target weights by a hypergeometric splitting tree, in DataFrame and SQL functions only.

Each source's documents fall into blocks by a seeded hash. A source's target fixes how many block draws the mix takes
from it: whole passes over all its blocks, then, in a seeded order, whatever still fits into what is left (see `_fill`).
These quotas are split exactly among output shards: a node of a binary tree over the shards hands each source's quota to
its two halves by a multivariate hypergeometric draw (conditional univariate draws, source after source), as if all block
draws had been shuffled and dealt out. A leaf thus knows how many draws of each source it gets, and takes that many from
the source's permuted draws; no draw goes to two shards. The rows of a mix are those draws: a document is emitted once for
each draw of its block that it belongs to, in the draw's shard, where records get a seeded order.

What the tree works on is one number per source and node. Documents meet it only by (source, block), which splits a
source of any size over many tasks; running sums and ranks within a source are taken cell by cell, from counts before
each cell.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import stored

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: No document is taken more often than this.
MOST = 3
#: Documents in a block on average, and blocks of a source at most. Larger sources have larger blocks, which are filled
#: part by part, with this many documents in a part on average.
BLOCK_ROWS, MOST_BLOCKS, PART_ROWS = 16, 1 << 20, 64
#: Bits of a place or hash that name its cell in the source's order.
_CELL_BITS = 10
SEED = 77_003

#: Words are runs of anything but the space and characters 9 to 13.
_WORDS = r"CAST(regexp_count(coalesce({0}, ''), '[^\\x20\\x09-\\x0D]+') AS bigint)"


def _hypergeometric(total: str, marked: str, drawn: str, uniform: str) -> str:
    """SQL for the number of marked items among `drawn` of `total`, by inversion of the cumulative weights.

    Weights run from the mode eight standard deviations either way, each from the one before by the ratio of
    neighbouring probabilities; what lies further out weighs less than a double can tell.
    """
    span = f"(CAST(ceil(8 * sqrt({drawn} * ({marked} / {total}) * (1 - {marked} / {total}))) AS bigint) + 8)"
    mode = f"(({drawn} + 1) * ({marked} + 1)) div ({total} + 2)"
    low = f"greatest(0L, {drawn} + {marked} - {total}, {mode} - {span})"
    high = f"least({drawn}, {marked}, {mode} + {span})"
    ratio = f"CAST({marked} - k AS double) * ({drawn} - k) / ((k + 1D) * ({total} - {marked} - {drawn} + k + 1))"
    weigh = f"aggregate(sequence(b.low, b.high), struct(1D AS w, 0D AS t), (s, k) -> struct(IF(k < b.high, s.w * {ratio}, 0D) AS w, s.t + s.w AS t), s -> s.t)"
    pick = (
        f"aggregate(sequence(b.low, b.high), struct(1D AS w, 0D AS t, b.low AS at), "
        f"(s, k) -> struct(IF(k < b.high, s.w * {ratio}, 0D) AS w, s.t + s.w AS t, IF(s.t + s.w <= {uniform} * weight AND k < b.high, k + 1, s.at) AS at), s -> s.at)"
    )
    inner = f"element_at(transform(array({weigh}), weight -> {pick}), 1)"
    draw = f"element_at(transform(array(struct({low} AS low, {high} AS high)), b -> {inner}), 1)"
    return f"CASE WHEN {total} <= 0 OR {marked} <= 0 OR {drawn} <= 0 THEN 0L WHEN {drawn} >= {total} THEN {marked} ELSE {draw} END"


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Splits exact quotas among shards whose totals differ by one at most.

    `quotas` has `idx` (0, 1, ... without gaps) and `quota`; returns `idx`, `shard`, `quota`. The state is one array of
    counts per node; an empty table gives no rows.
    """
    root = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "quota"))), lambda x: x["quota"].cast("long")).alias("q"))
    root = root.select(F.lit(0).alias("a"), F.lit(shards).alias("b"), "q", F.expr("aggregate(q, 0L, (s, x) -> s + x)").alias("all"))
    nodes = root
    uniform = f"(shiftrightunsigned(xxhash64({seed}L, a, b, size(p.out)), 11) / 9007199254740992D)"
    for _ in range((shards - 1).bit_length()):
        nodes = nodes.withColumn("mid", F.expr("(a + b) div 2"))
        nodes = nodes.withColumn("take", F.expr(f"IF(b - a > 1, (all * mid) div {shards} - (all * a) div {shards}, 0L)"))
        one = _hypergeometric("p.n", "x", "p.m", uniform)
        step = f"(p, x) -> element_at(transform(array({one}), d -> struct(p.n - x AS n, p.m - d AS m, concat(p.out, array(d)) AS out)), 1)"
        start = "struct(aggregate(q, 0L, (t, x) -> t + x) AS n, take AS m, CAST(array() AS array<bigint>) AS out)"
        nodes = nodes.withColumn("left", F.expr(f"aggregate(q, {start}, {step}, p -> p.out)"))
        halves = "IF(b - a > 1, array(struct(a AS a, mid AS b, left AS q), struct(mid AS a, b AS b, zip_with(q, left, (x, y) -> x - y) AS q)), array(struct(a AS a, b AS b, q AS q)))"
        nodes = nodes.select("all", F.explode(F.expr(halves)).alias("n")).select("all", "n.a", "n.b", "n.q")
    return nodes.select(F.col("a").alias("shard"), F.posexplode("q").alias("idx", "quota"))


@dataclass
class Mix:
    """What a mix consists of: per-source figures, and what each (source, block) gives."""

    sources: DataFrame
    blocks: DataFrame


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source (`source`, `n`, `source_size`), its `idx`, `weight` and `target`.

    Sources come in code-point order, null last, and share the total of all sizes by weight. A target stops at `most`
    times its source's size; the excess is shared again by weight until none is above. That is water filling: sources
    fill up in the order of size per weight, and the level of the others follows from what is left.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("idx"), F.lit(len(weights))).cast("int") + 1)
    s = sizes.withColumn("idx", F.row_number().over(order) - 1).withColumn("weight", weight.cast("double"))
    s = s.withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    all_, fill = W.partitionBy(), W.orderBy("ratio", "idx").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(all_).cast("double")).withColumn("weights", F.sum("weight").over(all_))
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(fill), F.lit(0.0))).withColumn("gone", F.coalesce(F.sum("weight").over(fill), F.lit(0.0)))
    # The level if all sources before this one are full; the first that stays below its cap fixes it for those after.
    level = (F.col("total") - F.col("before")) / (F.col("weights") - F.col("gone"))
    s = s.withColumn("level", F.when(level <= F.col("ratio"), level))
    s = s.withColumn("level", F.first("level", ignorenulls=True).over(W.orderBy("ratio", "idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap"))
    return s.select("source", "n", "source_size", "idx", "weight", target.alias("target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Adds `mix_source`, `mix_size` and the document's hash `mix_hash`."""
    quoted = "`" + text_col.replace("`", "``") + "`"
    return docs.withColumns(
        {
            "mix_source": F.col(source_col).cast("string"),
            "mix_size": F.expr(_WORDS.format(quoted)),
            "mix_hash": F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)),
        }
    )


def _with_before(rows: DataFrame, keys: list[str], place: str, amount: Column, name: str) -> DataFrame:
    """Rows with the sum of `amount` over all rows of their keys that come before them in the order of `place`.

    Places are whole numbers from 0 to 2**63, evenly spread. Sums run within a cell of places, behind the sum of all cells
    before it, so that no task sees more than a cell, or one row for each cell of its keys.
    """
    rows = rows.withColumn("cell", F.shiftright(place, 63 - _CELL_BITS).cast("int")).withColumn("amount", amount)
    cells = rows.groupBy(*keys, "cell").agg(F.sum("amount").alias("sum"))
    order = W.partitionBy(*keys).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(*keys, "cell", F.coalesce(F.sum("sum").over(order), F.lit(0)).alias("start"))
    inside = W.partitionBy(*keys, "cell").orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("amount").over(inside), F.lit(0)))
    return rows.join(cells, [*keys, "cell"]).withColumn(name, F.col("start") + F.col("inside")).drop("cell", "amount", "start", "inside")


def _fill(groups: DataFrame, rests: DataFrame) -> DataFrame:
    """Fills what is left of each source's target: `groups` with `extra`, whether their documents are taken once more.

    `groups` (`idx`, `block`, `pos` of the block's part in its source's seeded order, `mix_hash`, `size`) are walked through
    in order, and each that fits into the room left is taken. A round sums up, part by part, the groups that fit into the
    room it starts with; all parts before the one that crosses it are settled, that one is filled group by group, and the
    next round goes on behind it with what is left, until nothing fits. At last the one that brings the rest closest to
    nothing is taken, if one does.
    """
    state, rounds = rests.select("idx", F.lit(0).alias("at"), F.col("rest").cast("double").alias("room")), []
    while True:
        fits = groups.join(state, "idx").where((F.col("pos") > F.col("at")) & (F.col("size") > 0) & (F.col("size") <= F.col("room")))
        sums = fits.groupBy("idx", "at", "room", "pos").agg(F.sum("size").alias("size"))
        sums = _with_before(sums, ["idx"], "pos", F.col("size"), "end").withColumn("end", F.col("end") + F.col("size"))
        sums = stored(sums, "sums")
        inside = F.col("end") <= F.col("room")
        done = sums.groupBy("idx", "at", "room").agg(F.min(F.when(~inside, F.col("pos"))).alias("cross"), F.coalesce(F.max(F.when(inside, F.col("end"))), F.lit(0)).alias("used"))
        done = stored(done.withColumn("budget", F.col("room") - F.col("used")), "walked")
        crossed = done.where("cross IS NOT NULL").select("idx", F.col("cross").alias("pos"), "room", "budget")
        docs = groups.join(crossed, ["idx", "pos"]).where((F.col("size") > 0) & (F.col("size") <= F.col("room")))
        docs = docs.groupBy("idx", "budget").agg(F.array_sort(F.collect_list(F.struct("mix_hash", "size"))).alias("docs"))
        fold = "aggregate(docs, struct(budget AS room, CAST(array() AS array<bigint>) AS cut), (s, d) -> IF(d.size <= s.room, struct(s.room - d.size AS room, concat(s.cut, array(d.mix_hash)) AS cut), s))"
        filled = docs.select("idx", F.expr(fold).alias("f"))
        done = done.join(filled, "idx", "left").select("idx", "at", "cross", F.col("room").alias("limit"), F.coalesce("f.room", "budget").alias("room"), "f.cut")
        rounds.append(stored(done, "round"))
        state = rounds[-1].where("cross IS NOT NULL AND room >= 1").select("idx", F.col("cross").alias("at"), "room")
        if state.isEmpty():
            break
    walk = rounds[0]
    for r in rounds[1:]:
        walk = walk.union(r)
    walk = walk.groupBy("idx").agg(F.min("room").alias("room"), F.collect_list(F.struct("at", "cross", "limit", "cut")).alias("walk"))
    walk = rests.join(walk, "idx", "left").select("idx", F.coalesce("room", F.col("rest").cast("double")).alias("room"), "walk")
    walk = stored(walk, "walk")  # a row for each source, with a step for each of its rounds
    settled = "pos > w.at AND pos < coalesce(w.cross, pos + 1) AND size <= w.limit"
    extra = F.expr(f"coalesce(exists(walk, w -> {settled} OR (pos = w.cross AND coalesce(array_contains(w.cut, mix_hash), false))), false)")
    taken = groups.join(walk, "idx", "left").withColumn("extra", extra)
    off = F.abs(F.col("size") - F.col("room"))
    last = taken.where(~F.col("extra") & (F.col("size") > 0) & (off < F.col("room"))).groupBy("idx").agg(F.min(F.struct(off.alias("off"), "mix_hash")).alias("last"))
    taken = taken.join(stored(last.select("idx", F.col("last.mix_hash").alias("last")), "last"), "idx", "left")
    return taken.select("idx", "block", "mix_hash", "size", (F.col("extra") | F.coalesce(F.col("mix_hash") == F.col("last"), F.lit(False))).alias("extra"))


def _plan(rows: DataFrame, shards: int, weights: tuple[int, ...], most: int, block_rows: int, seed: int) -> Mix:
    """The plan of a mix over stored rows (`mix_source`, `mix_size`, `mix_hash`)."""
    sizes = rows.groupBy(F.col("mix_source").alias("source")).agg(F.count("*").alias("n"), F.sum("mix_size").alias("source_size"))
    s = source_targets(sizes, weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    s = s.withColumn("passes", F.least(F.floor(ratio + 1e-12), F.lit(most)).cast("int"))
    s = s.withColumn("rest", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0)))
    s = s.withColumn("n_blocks", F.least(F.ceil(F.col("n") / block_rows), F.lit(MOST_BLOCKS)).cast("int"))
    s = s.withColumn("n_parts", F.least(F.ceil(F.col("n") / F.col("n_blocks") / PART_ROWS), F.lit(4096)).cast("int"))
    s = stored(s, "sources")
    placed = _in_blocks(rows, s)
    groups = placed.groupBy("idx", "block", "mix_hash").agg(F.sum("mix_size").alias("size"), F.first("n_parts").alias("n_parts"))
    # A place in the source's order: 31 random bits, then the block and the part of it, which make it unique.
    part = F.pmod(F.xxhash64(F.lit(seed + 5), "mix_hash"), F.col("n_parts"))
    random = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "idx", "block"), 33), 32)
    pos = random + F.shiftleft(F.col("block").cast("long"), 12) + part
    groups = stored(groups.withColumn("pos", pos).drop("n_parts"), "groups")
    b = _fill(groups, s.where("rest > 0").select("idx", "rest")).groupBy("idx", "block").agg(
        F.bool_and("extra").alias("whole"), F.collect_list(F.when(F.col("extra"), F.col("mix_hash"))).alias("cut")
    )
    b = b.withColumn("cut", F.when(~F.col("whole") & (F.size("cut") > 0), F.col("cut"))).join(s.select("idx", "passes"), "idx")
    draws = b.withColumn("draws", F.col("passes") + F.when(F.col("whole") | F.col("cut").isNotNull(), 1).otherwise(0))
    draws = stored(draws, "draws")
    quotas = s.select("idx").join(draws.groupBy("idx").agg(F.sum("draws").alias("quota")), "idx", "left").select("idx", F.coalesce("quota", F.lit(0)).alias("quota"))
    leaves = split_quotas(quotas, shards, seed + 2)
    start = F.coalesce(F.sum("quota").over(W.partitionBy("idx").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    leaves = leaves.withColumn("start", start).where("quota > 0")
    leaves = leaves.select("idx", "shard", F.explode(F.expr("sequence(start, start + quota - 1)")).alias("draw"))
    each = draws.where("draws > 0").select("idx", "block", F.explode(F.expr("sequence(1, draws)")).alias("round"))
    # A draw's place among its source's: random bits, then block and round; its rank there is its number.
    random = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.lit(seed + 3), "idx", "block", "round"), 25), 24)
    each = each.withColumn("permuted", random + F.col("block").cast("long") * 8 + F.col("round"))
    each = _with_before(each, ["idx"], "permuted", F.lit(1).cast("long"), "draw")
    dealt = each.join(leaves, ["idx", "draw"]).groupBy("idx", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("round", "shard"))), lambda x: x["shard"]).alias("shards"))
    blocks = draws.join(dealt, ["idx", "block"], "left").select("idx", "block", "passes", "whole", "cut", "shards")
    return Mix(s, stored(blocks, "mix"))


def _in_blocks(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source's `idx` and their `block`."""
    rows = rows.join(sources.select("source", "idx", "n_blocks", "n_parts"), F.col("mix_source").eqNullSafe(F.col("source"))).drop("source")
    return rows.withColumn("block", F.pmod("mix_hash", F.col("n_blocks")).cast("int")).drop("n_blocks")


def _draws(rows: DataFrame, mix: Mix, seed: int) -> DataFrame:
    """Rows with `mix_draws`: shard and order there of each draw that takes them. The last draw of a block may be a partial one."""
    out = _in_blocks(rows, mix.sources).drop("n_parts").join(mix.blocks, ["idx", "block"])
    partial = "cardinality(shards) > passes AND NOT (whole OR coalesce(array_contains(cut, mix_hash), false))"
    mine = F.expr(f"slice(coalesce(shards, CAST(array() AS array<int>)), 1, IF({partial}, passes, coalesce(cardinality(shards), 0)))")
    order = lambda i: F.xxhash64(F.lit(seed + 4), "mix_hash", i)
    draws = F.transform(mine, lambda shard, i: F.struct(shard.alias("shard"), order(i).alias("order")))
    return out.withColumn("mix_draws", draws).drop("passes", "whole", "cut", "shards", "block")


def mix_report(docs: DataFrame, *, shards: int = 40, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_rows: int = BLOCK_ROWS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of `docs`: `doc_id`, `size`, `source_size`, `target` (its source's), `taken` (words, repeats counted), and `draws`,
    from which `taken` is counted: shard and order of each time the mix takes the row.

    Defined results: a null text has size 0; null is a source of its own, the last; sources without words have target 0
    and give none; repeated rows are all taken alike; the same rows give the same mix however they are stored.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(source_col).alias("s"))
    rows = stored(_sized(rows, "i", "t", "s", seed).drop("t", "s"), "sizes")
    mix = _plan(rows, shards, weights, most, block_rows, seed)
    out = _draws(rows, mix, seed).join(mix.sources.select("idx", "source_size", "target"), "idx")
    taken = F.col("mix_size") * F.size("mix_draws")
    return out.select(F.col("i").alias("doc_id"), F.col("mix_size").alias("size"), "source_size", "target", taken.alias("taken"), F.col("mix_draws").alias("draws"))


def mixed_documents(docs: DataFrame, *, shards: int = 40, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_rows: int = BLOCK_ROWS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_place: bool = False) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as it is taken, with their columns whatever their names.

    `with_place` adds `mix_shard` and `mix_order`, a seeded random order within the shard. Defined results as in
    `mix_report`.
    """
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    lower = [n.lower() for n in names]
    i, t, s = (inner[lower.index(c.lower())] for c in (id_col, text_col, source_col))
    rows = _sized(docs.toDF(*inner), i, t, s, seed)
    mix = _plan(stored(rows.select("mix_source", "mix_size", "mix_hash"), "sizes"), shards, weights, most, block_rows, seed)
    out = _draws(rows, mix, seed).select(*inner, F.explode("mix_draws").alias("mix_draw"))
    if not with_place:
        return out.select(*inner).toDF(*names)
    return out.select(*inner, "mix_draw.shard", "mix_draw.order").toDF(*names, "mix_shard", "mix_order")

"""Lookups, anti joins, two-sided differences and range joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_BOXES = 128  # boxes with one corner in a row of overlapping_boxes
TASK_BOXES = 40_000  # boxes for each of its tasks, as their pairs are many more


def lookup(facts: DataFrame, dim: DataFrame, on: Sequence[str], fill: dict[str, object] | None = None, missing: str | None = None) -> DataFrame:
    """Left join to a dimension; `fill` gives values for facts without a match, `missing` names a flag for them."""
    out = facts.join(dim.withColumn("_hit", F.lit(True)), list(on), "left")
    for c, v in (fill or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    if missing:
        out = out.withColumn(missing, F.col("_hit").isNull())
    return out.drop("_hit")


def unmatched(facts: DataFrame, known: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of `facts` without a match."""
    return facts.join(known, list(on), "left_anti")


def with_placeholders(known: DataFrame, refs: DataFrame, key: str, state: str = "state") -> DataFrame:
    """Known keys and a synthesised row for every referenced key that is not known."""
    made = refs.select(key).distinct().join(known, key, "left_anti").withColumn(state, F.lit("missing"))
    return known.select(key).distinct().withColumn(state, F.lit("known")).unionByName(made)


def used_before_defined(refs: DataFrame, defs: DataFrame, key: str, at: str) -> DataFrame:
    """References with `problem`: 'never' defined, or defined 'later' than (or at) the reference; the rest are left out."""
    first = defs.groupBy(key).agg(F.min(at).alias("first_def"))
    out = refs.join(first, key, "left")
    problem = F.when(F.col("first_def").isNull(), "never").when(F.col("first_def") >= F.col(at), "later")
    return out.withColumn("problem", problem).where("problem is not null")


def two_sided(left: DataFrame, right: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Compares two tables by key: `verdict` is only_left, only_right, differs or same."""
    a = left.select(*on, F.col(value).alias("left_value"), F.lit(True).alias("_a"))
    b = right.select(*on, F.col(value).alias("right_value"), F.lit(True).alias("_b"))
    verdict = (
        F.when(F.col("_b").isNull(), "only_left").when(F.col("_a").isNull(), "only_right").when(F.col("left_value").eqNullSafe(F.col("right_value")), "same").otherwise("differs")
    )
    return a.join(b, list(on), "full_outer").withColumn("verdict", verdict).drop("_a", "_b")


def range_buckets(points: DataFrame, point: str, ranges: DataFrame, low: str, high: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with `_level` and `_bucket` to join on.

    With an equality to hash on, a range join is no nested loop. A range [low, high) goes to the level whose buckets (of
    a power of two) are just as long as it is or longer, where it touches two at most, however long it is; a point goes to
    its bucket on each level in use, 63 at most.
    """
    a, b = F.col(low).cast("long"), F.col(high).cast("long") - 1
    r = ranges.where(F.col(low) < F.col(high)).withColumn("_level", F.when(a == b, 0).otherwise(F.length(F.bin(b - a))))

    def bucket(x: Column) -> Column:
        return F.call_function("shiftright", x, F.col("_level"))

    levels = F.broadcast(r.agg(F.collect_set("_level").alias("_levels")))  # one row of whole numbers up to 63
    p = points.crossJoin(levels).withColumn("_level", F.explode("_levels")).drop("_levels")
    p = p.withColumn("_bucket", bucket(F.floor(F.col(point)).cast("long")))
    return p, r.withColumn("_bucket", F.explode(F.array_distinct(F.array(bucket(a), bucket(b)))))


def contained(points: DataFrame, point: str, ranges: DataFrame, low: str, high: str, on: Sequence[str] = ()) -> DataFrame:
    """All pairs of a point and a range [low, high) of whole numbers that holds it."""
    p, r = range_buckets(points, point, ranges, low, high)
    return p.join(r, [*on, "_level", "_bucket"]).where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_level", "_bucket")


def innermost(pairs: DataFrame, point: Sequence[str], rank: Sequence[Column]) -> DataFrame:
    """Of the ranges that hold a point, the first by `rank`."""
    first = F.row_number().over(W.partitionBy(*point).orderBy(*rank))
    return pairs.withColumn("_rank", first).where("_rank = 1").drop("_rank")


def overlapping_boxes(boxes: DataFrame, key: str, cell: int, box: Sequence[str] = ("x0", "y0", "x1", "y1")) -> DataFrame:
    """Pairs (a < b) of boxes that overlap; boxes that merely touch do not.

    Boxes with the same lower corner go together, in blocks of `BLOCK_BOXES` by key. Of two blocks each box of one that
    reaches past the other's corner overlaps each such box of the other, so blocks are joined and their pairs written out
    as products, with no exchange behind the join; such runs of one id and repeated lists take few bytes in a file. Blocks are
    spread over the cells of a grid they touch and meet there; two of them count in the cell that holds the greater of their
    corners in x and in y, so a pair comes once. Empty boxes meet nothing.
    """
    full = boxes.select(F.col(key).alias("id"), *[F.col(c).alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"))]).where("id is not null and x0 < x1 and y0 < y1")
    block = F.floor((F.row_number().over(W.partitionBy("x0", "y0").orderBy("id")) - 1) / BLOCK_BOXES)
    blocks = full.withColumn("block", block).groupBy("x0", "y0", "block")
    blocks = blocks.agg(F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sort_array(F.collect_list(F.struct("id", "x1", "y1"))).alias("boxes"))

    def spread(low: str, high: str) -> Column:
        return F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))

    cells = blocks.withColumn("_cx", F.explode(spread("x0", "x1"))).withColumn("_cy", F.explode(spread("y0", "y1")))
    cells = cells.repartition(1 + full.count() // TASK_BOXES, "_cx", "_cy")
    a, b = (cells.select("_cx", "_cy", *[F.col(c).alias(f"{side}_{c}") for c in ("x0", "y0", "x1", "y1", "boxes")]) for side in "ab")
    meets = "a_x0 < b_x1 and b_x0 < a_x1 and a_y0 < b_y1 and b_y0 < a_y1 and a_boxes[0].id < element_at(b_boxes, -1).id"
    own = (F.floor(F.greatest("a_x0", "b_x0") / cell) == F.col("_cx")) & (F.floor(F.greatest("a_y0", "b_y0") / cell) == F.col("_cy"))
    met = b.join(a, ["_cx", "_cy"]).where(meets).where(own)

    def reaching(side: str, other: str) -> Column:
        past = F.filter(f"{side}_boxes", lambda v: (v["x1"] > F.col(f"{other}_x0")) & (v["y1"] > F.col(f"{other}_y0")))
        return F.transform(past, lambda v: v["id"]).alias(side)

    ids = met.select(reaching("a", "b"), reaching("b", "a"))
    return ids.select(F.explode("a").alias("a"), F.col("b").alias("bs")).select("a", F.explode("bs").alias("b")).where("a < b")


def claims_by_code(claims: DataFrame, low: str, high: str, owner: str, priority: str, seq: str | None = None) -> DataFrame:
    """Inclusive ranges of code numbers expanded to codes: `owner` of the first claim of the best priority (by `seq`, else the
    smallest), and `owners` that claim the code at that priority. One row for each code that is claimed."""
    codes = claims.withColumn("code", F.explode(F.sequence(F.col(low), F.col(high))))
    best = codes.groupBy("code").agg(F.min(F.struct(priority, F.col(seq or owner).alias("seq_"), F.col(owner).alias("owner_"))).alias("best"))
    codes = codes.join(best, "code").where(F.col(priority) == F.col(f"best.{priority}"))
    return codes.groupBy("code").agg(F.first("best.owner_").alias("owner"), F.countDistinct(owner).alias("owners"))


def claim_findings(claims: DataFrame, registered: DataFrame, documented: DataFrame) -> DataFrame:
    """What is wrong with the ownership of codes: `check`, `code`, `who`.

    `claims` (`lo`, `hi`, `owner`, `explicit`, `seq`; a null owner reserves the range), `registered` (`code`), `documented`
    (`code`, `owner`). Explicit claims come before others, which only fill gaps. overlap: two owners claim a code
    explicitly; reserved: a code in use lies in a reserved range; no-owner; owner-mismatch: documented by another than its
    owner; undocumented. A reserved code, and one without an owner, is reported as that alone.
    """
    explicit = claims.where("explicit")
    reserved = explicit.where("owner is null").select(F.explode(F.sequence("lo", "hi")).alias("code")).distinct()
    named = claims.where("owner is not null").withColumn("rank", F.when(F.col("explicit"), 0).otherwise(1))
    by_code = claims_by_code(named, "lo", "hi", "owner", "rank", "seq")
    twice = claims_by_code(named.where("explicit"), "lo", "hi", "owner", "rank", "seq").where("owners > 1")
    used = registered.select("code").distinct().join(reserved.withColumn("reserved", F.lit(True)), "code", "left").join(by_code.select("code", "owner"), "code", "left")
    free = used.where("reserved is null")
    owned = free.where("owner is not null")
    docs = documented.select("code", F.col("owner").alias("who")).distinct()

    def finding(check: str, rows: DataFrame, who: str | None = None) -> DataFrame:
        return rows.select(F.lit(check).alias("check"), "code", (F.col(who) if who else F.lit(None).cast(documented.schema["owner"].dataType)).alias("who"))

    out = finding("overlap", twice, "owner").unionByName(finding("reserved", used.where("reserved"))).unionByName(finding("no-owner", free.where("owner is null")))
    out = out.unionByName(finding("owner-mismatch", owned.join(docs, "code").where("who <> owner"), "who"))
    return out.unionByName(finding("undocumented", owned.join(docs, "code", "left_anti"), "owner"))

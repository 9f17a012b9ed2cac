"""Planners whose every step depends on the one before: batches, a first-in first-out cache, shelf packing.

Rows stream through their task sorted by group and order; only the open group's state is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.scalars import next_pow2


def _streamed(df: DataFrame, group: str, order: str, columns: list[str], schema: str, step: Callable[[], Callable[[dict], list[dict]]]) -> DataFrame:
    """Applies a fresh `step` to each group's rows in order; it returns rows to emit, and gets None at the end."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = list(dict.fromkeys([group, order, *columns]))
    rows = df.select(*names).repartition(parts, group).sortWithinPartitions(group, order)
    kinds = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, current, take, out = to_arrow_schema(kinds), None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if take is None or row[group] != current:
                    if take is not None:
                        out += take(None)
                    current, take = row[group], step()
                out += take(row)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if take is not None:
            out += take(None)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, schema)


def plan_batches(items: DataFrame, *, most_boxes: int = 64, most_materials: int = 8) -> DataFrame:
    """Draw batches of `items` (`scene`, `idx`, `material`, `opaque`, `clip`, `x0`, `y0`, `x1`, `y1`): `scene`, `segment`, `batch`, `material`, `n`.

    A segment of opaque items ends where an item overlaps one before it in the segment, where the clip changes, at 64
    boxes, or where a ninth material comes. In a segment, items of one material form a batch. A translucent item ends the
    segment and is a segment and a batch of its own, so nothing is merged across it.
    """

    def step() -> Callable[[dict | None], list[dict]]:
        state = {"segment": 0, "boxes": [], "clip": None, "open": {}, "out": []}

        def flush() -> list[dict]:
            rows = [{"scene": r["scene"], "segment": state["segment"], "batch": i, "material": r["material"], "n": r["n"]} for i, r in enumerate(state["out"])]
            if rows:
                state["segment"] += 1
            state.update(boxes=[], open={}, out=[])
            return rows

        def take(row: dict | None) -> list[dict]:
            if row is None:
                return flush()
            if not row["opaque"]:
                done = flush()
                state["out"].append({"scene": row["scene"], "material": row["material"], "n": 1})
                return done + flush()
            box = (row["x0"], row["y0"], row["x1"], row["y1"])
            meets = any(box[0] < b[2] and b[0] < box[2] and box[1] < b[3] and b[1] < box[3] for b in state["boxes"])
            full = len(state["boxes"]) >= most_boxes or (row["material"] not in state["open"] and len(state["open"]) >= most_materials)
            done = flush() if state["boxes"] and (meets or full or row["clip"] != state["clip"]) else []
            state["clip"] = row["clip"]
            state["boxes"].append(box)
            at = state["open"].setdefault(row["material"], len(state["out"]))
            if at == len(state["out"]):
                state["out"].append({"scene": row["scene"], "material": row["material"], "n": 0})
            state["out"][at]["n"] += 1
            return done

        return take

    columns = ["scene", "idx", "material", "opaque", "clip", "x0", "y0", "x1", "y1"]
    return _streamed(items, "scene", "idx", columns, "scene long, segment int, batch int, material long, n int", step)


def fifo_cache(uses: DataFrame, size: int) -> DataFrame:
    """Hits, misses and evictions of a first-in first-out cache per `run` over `uses` (`run`, `idx`, `key`); a hit refreshes nothing."""

    def step() -> Callable[[dict | None], list[dict]]:
        held: dict = {}
        tally = {"hits": 0, "misses": 0, "evictions": 0}
        run = [None]

        def take(row: dict | None) -> list[dict]:
            if row is None:
                return [{"run": run[0]} | tally]
            run[0] = row["run"]
            if row["key"] in held:
                tally["hits"] += 1
            else:
                tally["misses"] += 1
                held[row["key"]] = True
                if len(held) > size:
                    del held[next(iter(held))]
                    tally["evictions"] += 1
            return []

        return take

    return _streamed(uses, "run", "idx", ["run", "idx", "key"], "run long, hits long, misses long, evictions long", step)


def page_side(count: Column, most: int = 2048) -> Column:
    """The side of a font's pages, from the number of its drawable glyphs: a power of two from 512 to `most`."""
    wanted = F.greatest(F.lit(512), F.ceil(F.sqrt(F.greatest(count, F.lit(1)).cast("double")) * 56))
    return next_pow2(F.least(wanted, F.lit(most)), most)


def pack_shelves(glyphs: DataFrame, *, side: int | None = None, gutter: int = 2, most: int = 2048) -> DataFrame:
    """Places of `glyphs` (`font`, `idx`, `width`, `height`) on pages: left to right, then a new shelf, then a new page.

    Every glyph has a gutter on each side, and a shelf is as high as its highest glyph with both gutters. Pages of a font
    have one `side`, by default that of `page_side`. A glyph without area, or too large for a page of `most`, is not drawn
    and gets no place (null).
    """
    drawn = (F.col("width") > 0) & (F.col("height") > 0) & (F.col("width") + 2 * gutter <= most) & (F.col("height") + 2 * gutter <= most)
    counts = glyphs.groupBy("font").agg(F.count_if(drawn).alias("count"))
    sides = counts.select("font", (page_side(F.col("count"), most) if side is None else F.lit(side)).alias("side"))
    rows = glyphs.select("font", "idx", "width", "height", F.coalesce(drawn, F.lit(False)).alias("drawn")).join(sides, "font")

    def step() -> Callable[[dict | None], list[dict]]:
        at = {"page": 0, "x": gutter, "y": gutter, "shelf": 0, "used": False}

        def take(row: dict | None) -> list[dict]:
            if row is None:
                return []
            w, h, size = row["width"], row["height"], row["side"]
            if not row["drawn"]:
                return [{"font": row["font"], "idx": row["idx"], "side": size, "page": None, "x": None, "y": None}]
            if at["x"] + w + gutter > size:
                at.update(x=gutter, y=at["y"] + at["shelf"], shelf=0)
            if at["y"] + h + gutter > size and at["used"]:
                at.update(page=at["page"] + 1, x=gutter, y=gutter, shelf=0)
            out = {"font": row["font"], "idx": row["idx"], "side": size, "page": at["page"], "x": at["x"], "y": at["y"]}
            at.update(x=at["x"] + w + 2 * gutter, shelf=max(at["shelf"], h + 2 * gutter), used=True)
            return [out]

        return take

    return _streamed(rows, "font", "idx", ["font", "idx", "width", "height", "drawn", "side"], "font long, idx long, side int, page int, x int, y int", step)


def taken_names(names: DataFrame) -> DataFrame:
    """Names made unique per `scope` in the order of `idx`: a repeated base gets _2, _3, ..., skipping names already taken."""

    def step() -> Callable[[dict | None], list[dict]]:
        taken: set[str] = set()
        last: dict[str, int] = {}

        def take(row: dict | None) -> list[dict]:
            if row is None:
                return []
            base = name = row["base"]
            while name in taken:
                last[base] = last.get(base, 1) + 1
                name = f"{base}_{last[base]}"
            taken.add(name)
            return [{"scope": row["scope"], "idx": row["idx"], "name": name}]

        return take

    return _streamed(names, "scope", "idx", ["scope", "idx", "base"], "scope long, idx long, name string", step)


def tiers(reasons: DataFrame, hard: tuple[str, ...]) -> DataFrame:
    """Tier of each `block` from its `reason` rows in order of `idx`: 2 if any head is in `hard`, 1 for any other reason (known or not), 0 for none.

    The head is what precedes the first colon. `first` is the first hard reason, `reasons` the distinct ones.
    """
    head = F.split_part("reason", F.lit(":"), F.lit(1))
    r = reasons.withColumn("head", head).withColumn("hard", F.coalesce(head.isin(*hard), F.lit(False)))
    g = r.groupBy("block").agg(
        F.max("hard").alias("any_hard"), F.count("reason").alias("n"), F.min_by(F.when(F.col("hard"), F.col("reason")), F.when(F.col("hard"), F.col("idx"))).alias("first"), F.countDistinct("reason").alias("reasons")
    )
    return g.select("block", F.when(F.col("any_hard"), 2).when(F.col("n") > 0, 1).otherwise(0).alias("tier"), "first", "reasons")

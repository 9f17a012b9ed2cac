"""Ordered state folds: the display list and what follows from it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators.ordered import before, so_far, window


def carried(df: DataFrame, timeline: Sequence[str], slot: str, order: Sequence[str], removes: Column, carry: Sequence[str]) -> DataFrame:
    """State of each slot after every row: columns in `carry` keep their last non-null value since the slot was cleared.

    A removal clears its slot whatever it holds. `epoch` counts the removals of a slot so far.
    """
    keys = [*timeline, slot]
    df = df.withColumn("epoch", F.sum(F.when(removes, 1).otherwise(0)).over(so_far(keys, order)).cast("long"))
    over = so_far([*keys, "epoch"], order)
    return df.withColumns({c: F.last(F.when(~removes, F.col(c)), ignorenulls=True).over(over) for c in carry})


def fold_slots(df: DataFrame, timeline: Sequence[str], slot: str, order: Sequence[str], removes: Column, carry: Sequence[str]) -> DataFrame:
    """The list left after all rows: one row per occupied slot, with its merged columns and `placed` (rows merged)."""
    keys = [*timeline, slot]
    state = carried(df, timeline, slot, order, removes, carry).withColumn("gone", removes)
    last = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order]))
    placed = F.sum(F.when(~F.col("gone"), 1).otherwise(0)).over(W.partitionBy(*keys, "epoch")).cast("long")
    state = state.withColumn("placed", placed).withColumn("last", last)
    return state.where("last = 1 and not gone").select(*keys, *carry, "placed")


def snapshots(df: DataFrame, timeline: Sequence[str], frame: str, slot: str, order: Sequence[str], removes: Column, carry: Sequence[str]) -> DataFrame:
    """The list as it stands at the end of each frame: frames x occupied slots, with `since`, the frame a slot was filled.

    A slot's state at a frame is its last row up to that frame; it is spread over the frames until its next row, so no
    join is needed.
    """
    keys = [*timeline, slot]
    state = carried(df, timeline, slot, order, removes, carry).withColumn("gone", removes)
    filled = F.min(F.when(~F.col("gone"), F.col(frame))).over(W.partitionBy(*keys, "epoch"))
    state = state.withColumn("since", filled)
    end = F.row_number().over(W.partitionBy(*keys, frame).orderBy(*[F.col(o).desc() for o in order]))
    state = state.withColumn("end", end).where("end = 1").drop("end")
    final = F.max(frame).over(W.partitionBy(*timeline))
    until = F.coalesce(F.lead(frame).over(window(keys, [frame])) - 1, F.col("final"))
    state = state.withColumn("final", final).withColumn("until", until).where("not gone")
    spread = F.explode(F.sequence(F.col(frame), F.col("until"))).alias(frame)
    return state.drop("epoch").select(*timeline, spread, slot, *carry, "since")


def clip_ranges(df: DataFrame, group: Sequence[str], order: Sequence[str], slot: str, clip_to: str, name: str = "clip") -> DataFrame:
    """The mask in force for each row: a mask at slot s reaches to `clip_to`, and a later mask replaces an earlier one."""
    mask = F.when(F.col(clip_to).isNotNull(), F.struct(F.col(slot).alias("slot"), F.col(clip_to).alias("to")))
    last = F.last(mask, ignorenulls=True).over(before(group, order))
    df = df.withColumn("mask", last)
    holds = (F.col(slot) > F.col("mask.slot")) & (F.col(slot) <= F.col("mask.to"))
    return df.withColumn(name, F.when(holds, F.col("mask.slot"))).drop("mask")


def clip_boxes(df: DataFrame, group: Sequence[str], order: Sequence[str], slot: str, clip_to: str, box: Sequence[str], parent: Sequence[str], shown: Column) -> DataFrame:
    """The box that each row is cut to: its mask's, if one holds, intersected with the parent's. A null bound is open.

    Only rows that are `shown` are masks; a mask is cut by what holds before it, and shows nothing itself. The result's
    columns are those of `parent`, with `cut_` before their names.
    """
    mask = F.when(F.col(clip_to).isNotNull() & shown, F.struct(F.col(slot).alias("slot"), F.col(clip_to).alias("to"), *[F.col(b).alias(f"b{i}") for i, b in enumerate(box)]))
    df = df.withColumn("mask", F.last(mask, ignorenulls=True).over(before(group, order)))
    holds = (F.col(slot) > F.col("mask.slot")) & (F.col(slot) <= F.col("mask.to"))
    own = [F.when(holds, F.col(f"mask.b{i}")) for i in range(4)]
    cut = [F.greatest(F.col(p), o) if i < 2 else F.least(F.col(p), o) for i, (p, o) in enumerate(zip(parent, own, strict=True))]
    return df.withColumns({f"cut_{p}": c for p, c in zip(parent, cut, strict=True)}).drop("mask")


def playback(df: DataFrame, clock: Sequence[str], order: Sequence[str], elapsed: str, frame_ms: int, frames: int, name: str = "frame") -> DataFrame:
    """Frame shown after adding up elapsed milliseconds: floor(sum / duration), wrapped at the end."""
    total = F.sum(F.col(elapsed)).over(so_far(clock, order)).cast("long")
    df = df.withColumn("clock", total)
    return df.withColumn(name, F.pmod(F.expr(f"clock div {frame_ms}"), F.lit(frames)).cast("long"))


def fold_matching_removals(df: DataFrame, timeline: str, slot: str, order: str, kind: str, character: str) -> DataFrame:
    """The list after all rows where a removal only holds if its character is null or the one in the slot.

    That test needs the state itself, so rows are folded one after the other; they stream through the task sorted by
    timeline and order, and only the open timeline's list is kept.
    """
    schema = df.select(F.col(timeline).alias("timeline"), F.col(slot).cast("long").alias("slot"), F.col(order).alias("at"), F.col(kind).alias("kind"), F.col(character).cast("long").alias("character"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = schema.repartition(parts, "timeline").sortWithinPartitions("timeline", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, open_ = None, {}, False

        def out() -> pa.RecordBatch:
            slots = sorted(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([current] * len(slots), pa.int64()), pa.array(slots, pa.int64()), pa.array([held[s] for s in slots], pa.int64())], names=["timeline", "slot", "character"]
            )

        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("timeline", "slot", "kind", "character"))
            for t, s, k, c in zip(*cols, strict=True):
                if not open_ or t != current:
                    if open_:
                        yield out()
                    current, held, open_ = t, {}, True
                if k == "remove":
                    if s in held and (c is None or held[s] == c):
                        del held[s]
                elif k == "place":
                    held[s] = c if c is not None else held.get(s)
        if open_:
            yield out()

    return rows.mapInArrow(run, "timeline long, slot long, character long")

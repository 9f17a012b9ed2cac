"""Operators over ordered rows: segmentation, running state, first-seen flags, as-of values.

All take the partition columns and a total order. Frames are always given explicitly, so nothing depends on the
arrival order of rows. A partition is the unit of order (a timeline, a span, a scope), so it is also the unit of work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Keys = Sequence[str]


def window(partition: Keys, order: Keys) -> WindowSpec:
    return W.partitionBy(*partition).orderBy(*order)


def before(partition: Keys, order: Keys) -> WindowSpec:
    """All rows before the current one."""
    return window(partition, order).rowsBetween(W.unboundedPreceding, -1)


def so_far(partition: Keys, order: Keys) -> WindowSpec:
    """All rows up to the current one."""
    return window(partition, order).rowsBetween(W.unboundedPreceding, 0)


def _count(flag: Column, over: WindowSpec) -> Column:
    return F.coalesce(F.sum(F.when(flag, 1).otherwise(0)).over(over), F.lit(0)).cast("long")


def segment(df: DataFrame, partition: Keys, order: Keys, marker: Column, name: str = "frame") -> DataFrame:
    """Numbers segments by the markers *before* a row: a marker closes its segment and belongs to it."""
    return df.withColumn(name, _count(marker, before(partition, order)))


def segment_lagging(df: DataFrame, partition: Keys, order: Keys, marker: Column, name: str = "frame") -> DataFrame:
    """The other numbering: the first marker does not advance, each later one counts at once."""
    return df.withColumn(name, F.greatest(_count(marker, so_far(partition, order)) - 1, F.lit(0)).cast("long"))


def islands(df: DataFrame, partition: Keys, order: Keys, head: Column, name: str = "span") -> DataFrame:
    """Numbers spans that start at a head; rows before the first head are span 0."""
    return df.withColumn(name, _count(head, so_far(partition, order)))


def running_offset(df: DataFrame, partition: Keys, order: Keys, amount: str, name: str = "offset") -> DataFrame:
    """Exclusive prefix sum of `amount`."""
    return df.withColumn(name, F.coalesce(F.sum(amount).over(before(partition, order)), F.lit(0)).cast("long"))


def value_in_force(df: DataFrame, partition: Keys, order: Keys, value: Column, name: str, *, inclusive: bool) -> DataFrame:
    """The last non-null value before a row, or with `inclusive` up to and including it."""
    over = (so_far if inclusive else before)(partition, order)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(over))


def falls_behind(df: DataFrame, partition: Keys, order: Keys, position: str, name: str = "late") -> DataFrame:
    """Whether `position` is below the greatest one seen before it."""
    return df.withColumn(name, F.coalesce(F.col(position) < F.max(position).over(before(partition, order)), F.lit(False)))


def occurrence(df: DataFrame, partition: Keys, order: Keys, name: str = "nth") -> DataFrame:
    """1 for the first row of its partition, 2 for the next, and so on."""
    return df.withColumn(name, F.row_number().over(window(partition, order)).cast("long"))


def changes(df: DataFrame, partition: Keys, order: Keys, columns: Keys, name: str = "changed") -> DataFrame:
    """Whether any of `columns` differs from the row before; the first row changes nothing."""
    w = window(partition, order)
    first = F.row_number().over(w) == 1
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return df.withColumn(name, ~first & differs)


def padded_segments(counts: DataFrame, declared: DataFrame, partition: Keys, segment_col: str, declared_col: str) -> DataFrame:
    """`counts` per segment with the missing segments 0 .. declared - 1 added (null counts)."""
    wanted = declared.where(F.col(declared_col) > 0)
    wanted = wanted.select(*partition, F.explode(F.sequence(F.lit(0).cast("long"), F.col(declared_col).cast("long") - 1)).alias(segment_col))
    return wanted.join(counts, [*partition, segment_col], "full_outer")


def scene_ranges(df: DataFrame, partition: Keys, order: Keys, raw: str, limit: str) -> DataFrame:
    """Normalised start offsets: the running maximum of min(raw, limit), the first forced to 0; `end` is the next start,
    or `limit` at the end; `backward` flags raw offsets below the raw one before."""
    w = window(partition, order)
    held = F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise(F.least(F.col(raw), F.col(limit)))
    df = df.withColumn("held", held)
    df = df.withColumn("start", F.max("held").over(so_far(partition, order))).drop("held")
    df = df.withColumn("end", F.coalesce(F.lead("start").over(w), F.col(limit)))
    return df.withColumn("backward", F.coalesce(F.col(raw) < F.lag(raw).over(w), F.lit(False)))

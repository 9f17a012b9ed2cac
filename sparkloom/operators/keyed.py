"""Keyed reductions: which of the rows that share a key counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: Sequence[str], order: str, *, last: bool = False) -> DataFrame:
    """One whole row per key: the one with the smallest (with `last`: greatest) order.

    A pre-aggregated minimum over the row as a struct, so a key with very many rows is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in (*key, order)]
    row = F.struct(order, *rest)
    picked = df.groupBy(*key).agg((F.max if last else F.min)(row).alias("row"))
    return picked.select(*[F.col(c) if c in key else F.col(f"row.{c}") for c in df.columns])


def flag_shadowed(df: DataFrame, key: Sequence[str], order: str, name: str = "shadowed") -> DataFrame:
    """All rows, with those flagged that a later row with the same key replaces."""
    return df.withColumn(name, F.col(order) < F.max(order).over(W.partitionBy(*key)))


def extreme_value(df: DataFrame, key: Sequence[str], value: str, by: str, *, last: bool = False) -> DataFrame:
    """Per key the value at the smallest (or greatest) `by`."""
    return df.groupBy(*key).agg((F.max_by if last else F.min_by)(value, by).alias(value))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def dedupe(df: DataFrame, signature: Sequence[str], order: str) -> DataFrame:
    """The first row of each signature."""
    return first_wins(df, signature, order)


def group_by_form(df: DataFrame, form: Column, spread: str, key: Sequence[str] = ()) -> DataFrame:
    """Groups rows by the digest of a canonical form: `form`, `n`, `spread` (distinct values of a column)."""
    return df.withColumn("form", F.sha2(form, 256)).groupBy(*key, "form").agg(F.count("*").alias("n"), F.countDistinct(spread).alias("spread"))

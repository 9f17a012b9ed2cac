"""Global order: row numbers and first-n reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators.graphs import cut


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str = "n") -> DataFrame:
    """Adds 1, 2, 3, ... in a global total order.

    Rows are range partitioned and numbered within partitions; the first number of each partition follows from the row
    counts of those before it, a table with one row per partition. No task sees all rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    first = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    out = ranged.withColumn("_at", within).join(counts.select("_part", first.alias("_first")), "_part")
    return out.withColumn(name, (F.col("_first") + F.col("_at")).cast("long")).drop("_part", "_at", "_first")


def first_and_more(df: DataFrame, order: Sequence[str | Column], n: int, name: str = "rank") -> DataFrame:
    """The first `n` rows with their rank, and `more`: how many rows there are beyond."""
    top = df.orderBy(*order).limit(n)
    ranked = top.withColumn(name, F.row_number().over(W.orderBy(*order)).cast("long"))
    return ranked.crossJoin(F.broadcast(df.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))))

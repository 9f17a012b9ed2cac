"""Signal and scan-line queries: samples by user, edges by supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.plans.registry import Tables, query

_SIG = "(SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, CAST(floor(value * 100) AS BIGINT) % 1000 - 500 AS v FROM events)"


def samples(t: Tables) -> DataFrame:
    i = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    return t.events.select("user_id", i.cast("long").alias("i"), (F.floor(F.col("value") * 100).cast("long") % 1000 - 500).alias("v"))


@query(
    f"""SELECT user_id, max(abs(v)) AS peak, CAST(sum(v * v) AS BIGINT) AS energy, CASE WHEN sum(v * v) = 0 THEN NULL ELSE round(20 * log10(sqrt(sum(v * v) / count(*)) / 500.0), 2) END AS dbfs,
    sum(v * v) * 4 <= count(*) AS gated, max(abs(v)) = 0 AS silent FROM (SELECT user_id, CASE WHEN user_id % 9 = 0 THEN 0 WHEN user_id % 9 = 1 THEN i % 4 // 3 WHEN user_id % 9 = 2 THEN i % 2 ELSE v END AS v FROM {_SIG}) GROUP BY ALL"""
)
def signal_levels(t: Tables) -> DataFrame:
    """Peak and level of each signal, full scale being 500; silence has no level, and the gate closes at -60 dB or less."""
    v, u = F.col("v"), F.col("user_id") % 9
    quiet = F.when(u == 0, 0).when(u == 1, F.floor(F.col("i") % 4 / 3)).when(u == 2, F.col("i") % 2).otherwise(v)  # a few signals at and around the gate
    g = samples(t).withColumn("v", quiet.cast("long")).groupBy("user_id").agg(F.max(F.abs(v)).alias("peak"), F.sum(v * v).alias("energy"), F.count("*").alias("n"))
    rms = F.sqrt(F.col("energy") / F.col("n")) / 500.0
    level = F.when(F.col("energy") > 0, 20 * F.log10(rms))
    return g.select("user_id", "peak", "energy", F.round(level, 2).alias("dbfs"), (rms <= 0.001).alias("gated"), (F.col("energy") == 0).alias("silent"))


@query(f"SELECT user_id, i // 16 AS chunk, max(abs(v)) AS peak, count(*) AS n FROM {_SIG} GROUP BY ALL")
def chunk_peaks(t: Tables) -> DataFrame:
    """Peaks of chunks of fixed length."""
    return samples(t).groupBy("user_id", F.floor(F.col("i") / 16).cast("long").alias("chunk")).agg(F.max(F.abs("v")).alias("peak"), F.count("*").alias("n"))


@query(
    f"""WITH s AS (SELECT * FROM {_SIG}), l AS (SELECT user_id, count(*) AS n FROM s GROUP BY ALL),
    o AS (SELECT user_id, n, unnest(range(0, CAST(round(n * 2 / 3) AS BIGINT))) AS k FROM l), p AS (SELECT user_id, k, k * 3 // 2 AS j, k * 3 % 2 AS w, n FROM o),
    q AS (SELECT p.user_id, p.k, a.v * (2 - w) + coalesce(b.v, a.v) * w AS num FROM p JOIN s a ON a.user_id = p.user_id AND a.i = p.j LEFT JOIN s b ON b.user_id = p.user_id AND b.i = p.j + 1)
    SELECT user_id, k, CASE WHEN num < 0 THEN -((-num + 1) // 2) ELSE (num + 1) // 2 END AS v FROM q"""
)
def resample(t: Tables) -> DataFrame:
    """Samples at two thirds of the rate, by rational weights with rounded division; the length is rounded, too.

    Output k lies between the inputs floor(3 k / 2) and the next. Each input sends itself to the outputs it takes part
    in, so no self-join is needed.
    """
    s = samples(t)
    w = W.partitionBy("user_id")
    s = s.withColumn("n", F.count("*").over(w)).withColumn("next", F.coalesce(F.lead("v").over(w.orderBy("i")), F.col("v")))
    # Input i is the base of outputs k with 3 k div 2 = i: k = ceil(2 i / 3) while 3 k < 2 i + 2.
    k = F.expr("(2 * i + 2) div 3")
    s = s.withColumn("k", k).where("3 * k < 2 * i + 2 and k < (n * 2 + 1) div 3")
    num = F.col("v") * (2 - F.col("k") * 3 % 2) + F.col("next") * (F.col("k") * 3 % 2)
    s = s.withColumn("num", num)
    return s.select("user_id", "k", F.expr("CASE WHEN num < 0 THEN -((-num + 1) div 2) ELSE (num + 1) div 2 END").alias("v"))


_EDGE = """(SELECT s_nationkey AS shape, s_suppkey AS edge, s_suppkey * 13 % 97 AS x, s_suppkey * 7 % 40 AS y0, s_suppkey * 7 % 40 + 5 + s_suppkey % 9 AS y1,
  CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END AS dir FROM supplier)"""


@query(
    f"""WITH c AS (SELECT shape, edge, x, dir, unnest(range(y0, y1)) AS y FROM {_EDGE}),
    w AS (SELECT shape, y, x, lead(x) OVER o AS nx, CAST(sum(dir) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS winding FROM c WINDOW o AS (PARTITION BY shape, y ORDER BY x, edge))
    SELECT shape, y, x AS x0, nx AS x1, winding FROM w WHERE nx > x AND winding <> 0"""
)
def winding_spans(t: Tables) -> DataFrame:
    """Filled spans of each scan line by the non-zero rule: edges spread over the rows they cross, then a running winding."""
    k = F.col("s_suppkey")
    e = t.supplier.select(F.col("s_nationkey").alias("shape"), k.alias("edge"), (k * 13 % 97).alias("x"), (k * 7 % 40).alias("y0"), (k * 7 % 40 + 5 + k % 9).alias("y1"), F.when(k % 2 == 0, 1).otherwise(-1).alias("dir"))
    c = e.select("shape", "edge", "x", "dir", F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"))
    o = W.partitionBy("shape", "y").orderBy("x", "edge")
    c = c.withColumn("nx", F.lead("x").over(o)).withColumn("winding", F.sum("dir").over(o.rowsBetween(W.unboundedPreceding, 0)))
    return c.where("nx > x and winding <> 0").select("shape", "y", F.col("x").alias("x0"), F.col("nx").alias("x1"), "winding")

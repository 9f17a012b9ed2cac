"""Name synthesis and de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.ordered import occurrence
from sparkloom.plans.keyed import DICT, entries
from sparkloom.plans.registry import Tables, query


@query(f"SELECT id, idx, kind || id || '_' || lpad(CAST(row_number() OVER (PARTITION BY id, kind ORDER BY idx) AS VARCHAR), 2, '0') AS name FROM {DICT}")
def synthetic_names(t: Tables) -> DataFrame:
    """Names from kind, owner and a running number of two digits at least."""
    e = occurrence(entries(t), ["id", "kind"], ["idx"])
    n = F.when(F.col("nth") < 10, F.concat(F.lit("0"), F.col("nth"))).otherwise(F.col("nth").cast("string"))
    return e.select("id", "idx", F.concat("kind", "id", F.lit("_"), n).alias("name"))


@query(f"SELECT idx, CASE WHEN n = 1 THEN kind || id ELSE kind || id || '__' || (n - 1) END AS name FROM (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY idx) AS n FROM {DICT})")
def dedupe_suffix0(t: Tables) -> DataFrame:
    """Repeated names with suffixes __1, __2 in order."""
    e = occurrence(entries(t), ["kind", "id"], ["idx"])
    base = F.concat("kind", "id")
    return e.select("idx", F.when(F.col("nth") == 1, base).otherwise(F.concat(base, F.lit("__"), F.col("nth") - 1)).alias("name"))


@query(f"SELECT idx, CASE WHEN n = 1 THEN kind || id ELSE kind || id || '_' || n END AS name FROM (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY idx) AS n FROM {DICT})")
def dedupe_suffix(t: Tables) -> DataFrame:
    """Repeated names with suffixes _2, _3; no base here equals a suffixed name, so no suffix is taken already."""
    e = occurrence(entries(t), ["kind", "id"], ["idx"])
    base = F.concat("kind", "id")
    return e.select("idx", F.when(F.col("nth") == 1, base).otherwise(F.concat(base, F.lit("_"), F.col("nth"))).alias("name"))

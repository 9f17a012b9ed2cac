"""Two-sided comparisons, sets, canonical forms and global order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import joins as j
from sparkloom.operators import sorting as s
from sparkloom.plans.registry import Tables, query

_A = "(SELECT p_partkey, p_name, p_size FROM part WHERE p_size <= 25)"
_B = "(SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS p_name, p_size FROM part WHERE p_size >= 20)"


def sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    p = t.part.select("p_partkey", "p_name", "p_size")
    changed = F.when(F.col("p_partkey") % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return p.where("p_size <= 25"), p.where("p_size >= 20").withColumn("p_name", changed)


@query(
    f"""SELECT p_partkey, a.p_name AS left_value, b.p_name AS right_value, CASE WHEN b.p_partkey IS NULL THEN 'only_left' WHEN a.p_partkey IS NULL THEN 'only_right'
    WHEN a.p_name IS NOT DISTINCT FROM b.p_name THEN 'same' ELSE 'differs' END AS verdict FROM {_A} a FULL JOIN {_B} b USING (p_partkey)"""
)
def build_diff(t: Tables) -> DataFrame:
    """Two builds by path: only in one, different, or the same."""
    a, b = sides(t)
    return j.two_sided(a, b, ["p_partkey"], "p_name").select("p_partkey", "left_value", "right_value", "verdict")


@query(
    f"""SELECT p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'missing' WHEN a.p_partkey IS NULL THEN 'unreferenced' WHEN a.size IS NOT NULL AND a.size <> b.p_size THEN 'mismatch'
    WHEN a.name <> b.p_name THEN 'mismatch' ELSE 'ok' END AS verdict
    FROM (SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 3 > 0 THEN p_size + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END END AS size FROM {_A}) a FULL JOIN {_B} b USING (p_partkey)"""
)
def manifest_check(t: Tables) -> DataFrame:
    """Manifest entries against files; a size that is not stated is not compared."""
    a, b = sides(t)
    key = F.col("p_partkey")
    stated = F.when(key % 3 > 0, F.col("p_size") + F.when(key % 11 == 0, 1).otherwise(0))
    a = a.select("p_partkey", F.col("p_name").alias("name"), stated.alias("size"), F.lit(True).alias("listed"))
    out = a.join(b.withColumn("there", F.lit(True)), "p_partkey", "full_outer")
    wrong = (F.col("size").isNotNull() & (F.col("size") != F.col("p_size"))) | (F.col("name") != F.col("p_name"))
    return out.select("p_partkey", F.when(F.col("there").isNull(), "missing").when(F.col("listed").isNull(), "unreferenced").when(wrong, "mismatch").otherwise("ok").alias("verdict"))


_LEAVES = """(SELECT event_id, 'props.k' AS path, json_extract_string(props, '$.k') AS leaf FROM events UNION ALL
  SELECT event_id, 'meta.type', event_type FROM events UNION ALL SELECT event_id, 'meta.ids', user_id || ',' || event_id FROM events)"""


def leaves(t: Tables) -> DataFrame:
    """Dotted scalar leaves of a nested row; arrays are joined by commas."""
    e = t.events
    k = F.from_json("props", "k int")["k"].cast("string")
    ids = F.concat_ws(",", F.array(F.col("user_id").cast("string"), F.col("event_id").cast("string")))
    each = F.array(*[F.struct(F.lit(p).alias("path"), v.alias("leaf")) for p, v in (("props.k", k), ("meta.type", F.col("event_type")), ("meta.ids", ids))])
    return e.select("event_id", F.inline(each))


@query(f"SELECT * FROM {_LEAVES} WHERE leaf IS NOT NULL")
def scalar_leaves(t: Tables) -> DataFrame:
    """Nested settings flattened to dotted leaves."""
    return leaves(t).where("leaf is not null")


@query(
    f"""WITH l AS (SELECT event_id, path, leaf FROM {_LEAVES} WHERE event_id % 2 = 0), r AS (SELECT event_id - 1 AS event_id, path, leaf FROM {_LEAVES} WHERE event_id % 2 = 1 AND path <> 'meta.ids')
    SELECT event_id, path, l.leaf AS left_value, r.leaf AS right_value, CASE WHEN r.event_id IS NULL THEN 'only_left' WHEN l.event_id IS NULL THEN 'only_right'
      WHEN l.leaf IS NOT DISTINCT FROM r.leaf THEN 'same' ELSE 'differs' END AS verdict FROM l FULL JOIN r USING (event_id, path) WHERE l.leaf IS DISTINCT FROM r.leaf"""
)
def json_diff(t: Tables) -> DataFrame:
    """Differences of two documents by path: each even event against the odd one after it."""
    x = leaves(t)
    a = x.where("event_id % 2 = 0")
    b = x.where("event_id % 2 = 1 and path <> 'meta.ids'").withColumn("event_id", F.col("event_id") - 1)
    return j.two_sided(a, b, ["event_id", "path"], "leaf").where("verdict <> 'same'").select("event_id", "path", "left_value", "right_value", "verdict")


@query(f"SELECT 'left' AS side, p_partkey FROM (SELECT p_partkey FROM {_A} EXCEPT SELECT p_partkey FROM {_B}) UNION ALL SELECT 'right', p_partkey FROM (SELECT p_partkey FROM {_B} EXCEPT SELECT p_partkey FROM {_A})")
def set_diff(t: Tables) -> DataFrame:
    """What is only on either side."""
    a, b = (x.select("p_partkey") for x in sides(t))
    return a.exceptAll(b).select(F.lit("left").alias("side"), "p_partkey").unionByName(b.exceptAll(a).select(F.lit("right").alias("side"), "p_partkey"))


@query(
    f"""SELECT CASE WHEN b.p_partkey IS NULL THEN 'stale' WHEN a.p_partkey IS NULL THEN 'missing' ELSE 'covered' END AS disposition, count(*) AS n
    FROM {_A} a FULL JOIN {_B} b USING (p_partkey) GROUP BY ALL"""
)
def coverage_diff(t: Tables) -> DataFrame:
    """Counts by disposition: covered, missing, stale."""
    a, b = sides(t)
    v = j.two_sided(a, b, ["p_partkey"], "p_size").select(F.when(F.col("verdict") == "only_left", "stale").when(F.col("verdict") == "only_right", "missing").otherwise("covered").alias("disposition"))
    return v.groupBy("disposition").agg(F.count("*").alias("n"))


@query("SELECT i AS code FROM range(256) r(i) WHERE i NOT IN (SELECT p_size FROM part)")
def domain_complement(t: Tables) -> DataFrame:
    """Codes of a closed domain that nothing defines."""
    return j.unmatched(t.spark.range(256).toDF("code"), t.part.select(F.col("p_size").cast("long").alias("code")), ["code"])


@query("SELECT regexp_extract(url, '//([^/]*)', 1) AS path, count(DISTINCT page_id % 3) AS stages FROM pages GROUP BY ALL HAVING count(DISTINCT page_id % 3) > 1")
def write_conflicts(t: Tables) -> DataFrame:
    """Paths that more than one stage writes."""
    return t.pages.groupBy(F.regexp_extract("url", "//([^/]*)", 1).alias("path")).agg(F.countDistinct(F.col("page_id") % 3).alias("stages")).where("stages > 1")


@query("""SELECT event_id, sha256('{"event_type":"' || event_type || '","props":' || replace(props, ' ', '') || ',"user_id":' || user_id || '}') AS digest FROM events""")
def canonical_digest(t: Tables) -> DataFrame:
    """Digest of a row's JSON with its keys sorted."""
    form = F.to_json(F.struct("event_type", F.from_json("props", "k int").alias("props"), "user_id"))
    return t.events.select("event_id", F.sha2(form, 256).alias("digest"))


@query(
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey END NULLS FIRST, o_orderstatus, o_orderkey) AS n FROM orders"""
)
def total_order(t: Tables) -> DataFrame:
    """A total order by four keys, one of them with nulls first."""
    o = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus", F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey")).alias("owner"))
    return s.number_rows(o, ["o_orderpriority", F.asc_nulls_first("owner"), "o_orderstatus", "o_orderkey"]).select("o_orderkey", "n")


@query("SELECT event_id, row_number() OVER (ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, event_type, user_id, event_id) AS n FROM events")
def findings_sort(t: Tables) -> DataFrame:
    """Findings by severity, check, path and line."""
    sev = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    e = t.events.select("event_id", "event_type", "user_id", sev.alias("severity"))
    return s.number_rows(e, ["severity", "event_type", "user_id", "event_id"]).select("event_id", "n")


@query("SELECT o_orderkey, n AS rank, (SELECT count(*) - 50 FROM orders) AS more FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 50")
def limit_more(t: Tables) -> DataFrame:
    """The first fifty, and how many more there are."""
    o = t.orders.select("o_orderkey", "o_totalprice")
    return s.first_and_more(o, [F.desc("o_totalprice"), F.asc("o_orderkey")], 50).select("o_orderkey", "rank", "more")

"""Lookups, anti joins and membership filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import joins as j
from sparkloom.plans.registry import Tables, query
from sparkloom.plans.timeline import ROWS, rows


@query("SELECT doc_id, coalesce(quality, -1) AS quality, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_lookup(t: Tables) -> DataFrame:
    """Documents with their label; a missing one gives a default and a flag."""
    return j.lookup(t.documents.select("doc_id"), t.labels, ["doc_id"], {"quality": -1}, "missing").select("doc_id", "quality", "missing")


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def unclaimed_anti(t: Tables) -> DataFrame:
    """Documents that no label claims."""
    return j.unmatched(t.documents.select("doc_id", "source"), t.labels.select("doc_id"), ["doc_id"])


_DEFS = "SELECT DISTINCT character AS id FROM r WHERE kind = 'signup' UNION SELECT DISTINCT depth FROM r"


@query(f"WITH r AS (SELECT * FROM {ROWS}) SELECT timeline, idx, character AS id FROM r WHERE kind = 'view' AND character NOT IN ({_DEFS})")
def undefined_refs(t: Tables) -> DataFrame:
    """Placements that name an id neither defined nor imported."""
    r = rows(t)
    defs = r.where("kind = 'signup'").select(F.col("character").alias("id")).union(r.select("depth")).distinct()
    return j.unmatched(r.where("kind = 'view'").select("timeline", "idx", F.col("character").alias("id")), defs, ["id"]).select("timeline", "idx", "id")


@query(
    f"""WITH r AS (SELECT * FROM {ROWS}), k AS (SELECT DISTINCT character AS id FROM r WHERE kind = 'signup')
    SELECT id, 'known' AS state FROM k UNION ALL SELECT DISTINCT character, 'missing' FROM r WHERE kind = 'view' AND character NOT IN (SELECT id FROM k)"""
)
def missing_placeholders(t: Tables) -> DataFrame:
    """Known ids, and a placeholder for each id that is only referred to."""
    r = rows(t)
    return j.with_placeholders(r.where("kind = 'signup'").select(F.col("character").alias("id")), r.where("kind = 'view'").select(F.col("character").alias("id")), "id")


@query(
    """SELECT DISTINCT l_partkey AS module, l_linenumber AS name FROM lineitem WHERE l_returnflag = 'A'
    AND (l_partkey, l_linenumber) NOT IN (SELECT l_partkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'A')"""
)
def dangling_refs(t: Tables) -> DataFrame:
    """Imported names that their module does not export."""
    li = t.lineitem.select(F.col("l_partkey").alias("module"), F.col("l_linenumber").alias("name"), "l_returnflag")
    return j.unmatched(li.where("l_returnflag = 'A'").select("module", "name").distinct(), li.where("l_returnflag <> 'A'").select("module", "name"), ["module", "name"])


@query(
    """SELECT DISTINCT p_brand AS module, p_name AS name FROM part WHERE p_size < 20 AND NOT EXISTS (
      SELECT 1 FROM part q WHERE q.p_size >= 20 AND q.p_brand = part.p_brand AND q.p_name = part.p_name)
    AND p_brand <> 'Brand#1' AND NOT (p_brand = 'Brand#2' AND p_name = 'red bolt') AND NOT starts_with(p_name, 'small')"""
)
def unused_exports(t: Tables) -> DataFrame:
    """Exports that nobody imports, but for an allow-list of whole modules, exact names and prefixes."""
    p = t.part.select(F.col("p_brand").alias("module"), F.col("p_name").alias("name"), "p_size")
    allowed = (F.col("module") == "Brand#1") | ((F.col("module") == "Brand#2") & (F.col("name") == "red bolt")) | F.col("name").startswith("small")
    return j.unmatched(p.where("p_size < 20").select("module", "name").distinct().where(~allowed), p.where("p_size >= 20").select("module", "name"), ["module", "name"])


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'unknown' END AS meaning FROM orders")
def dim_decode(t: Tables) -> DataFrame:
    """Codes decoded by a small dimension of fixed size, with a default."""
    dim = t.spark.createDataFrame([("O", "open"), ("F", "filled")], "o_orderstatus string, meaning string")
    return j.lookup(t.orders.select("o_orderkey", "o_orderstatus"), F.broadcast(dim), ["o_orderstatus"], {"meaning": "unknown"}).select("o_orderkey", "meaning")


@query(
    """SELECT doc_id, sha256(text) AS sha, CASE WHEN doc_id % 7 = 0 THEN 'unpinned' WHEN text IS NULL THEN 'missing' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'verified' END AS state FROM documents
    UNION ALL SELECT -1 - r_regionkey, NULL, 'missing' FROM region"""
)
def hash_verify(t: Tables) -> DataFrame:
    """Digests of whole texts held against a manifest that lacks some, pins others wrongly, and names files that are not there."""
    k = F.col("doc_id")
    pinned = F.when(k % 5 == 0, F.sha2(F.concat(F.coalesce("text", F.lit("")), F.lit("!")), 256)).otherwise(F.sha2(F.coalesce("text", F.lit("")), 256))
    manifest = t.documents.where(k % 7 != 0).select("doc_id", pinned.alias("pinned")).unionByName(t.region.select((-1 - F.col("r_regionkey")).alias("doc_id"), F.lit("00").alias("pinned")))
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("sha"), F.lit(True).alias("there"))
    state = F.when(F.col("pinned").isNull(), "unpinned").when(F.col("sha").isNull(), "missing").when(F.col("sha") != F.col("pinned"), "changed").otherwise("verified")
    return d.join(manifest, "doc_id", "full_outer").select("doc_id", "sha", state.alias("state"))


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'click')")
def set_membership(t: Tables) -> DataFrame:
    """Rows whose code is in a constant set."""
    return t.events.where(F.col("event_type").isin("view", "click")).select("event_id")


@query("SELECT timeline, idx, kind FROM (SELECT *, CASE WHEN character % 4 = 1 THEN depth END AS sprite FROM " + ROWS + ") WHERE sprite IS NULL")
def toplevel_filter(t: Tables) -> DataFrame:
    """Tags that lie in no sprite."""
    r = rows(t).withColumn("sprite", F.when(F.col("character") % 4 == 1, F.col("depth")))
    return r.where(F.col("sprite").isNull()).select("timeline", "idx", "kind")


@query(f"SELECT timeline, row_number() OVER (PARTITION BY timeline ORDER BY depth, idx) AS n, depth, idx FROM {ROWS} WHERE kind IN ('view', 'click') AND depth <> 3")
def state_records(t: Tables) -> DataFrame:
    """Records of one state, by depth and then authored order."""
    from sparkloom.operators.ordered import occurrence

    r = rows(t).where(F.array_contains(F.array(F.lit("view"), F.lit("click")), F.col("kind")) & (F.col("depth") != 3))
    return occurrence(r, ["timeline"], ["depth", "idx"], "n").select("timeline", "n", "depth", "idx")


@query("SELECT p_name AS name, p_partkey AS id, row_number() OVER (ORDER BY p_name, p_partkey) AS n FROM part")
def symbol_view(t: Tables) -> DataFrame:
    """Exports in the order of their names; the number states the order."""
    p = t.part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"))
    return numbered(p, ["name", "id"])


def numbered(df: DataFrame, order: list, name: str = "n") -> DataFrame:
    """Row numbers in a global order without a single-task window: a range sort, then counts before each partition."""
    from sparkloom.operators.sorting import number_rows

    return number_rows(df, order, name)


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('both', 'click')")
def tracking_filter(t: Tables) -> DataFrame:
    """Transitions for one tracking mode, or for both."""
    return t.events.where(F.col("event_type").isin("both", "click")).select("event_id", "event_type")

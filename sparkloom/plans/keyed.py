"""First-wins and last-wins queries over a dictionary: events keyed by their id modulo 97."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import keyed as k
from sparkloom.plans.registry import Tables, query

DICT = "(SELECT event_id % 97 AS id, event_id AS idx, event_type AS kind, CAST(floor(value) AS BIGINT) AS size FROM events WHERE event_id % 97 <> 0) AS d"


def entries(t: Tables) -> DataFrame:
    e = t.events.select((F.col("event_id") % 97).alias("id"), F.col("event_id").alias("idx"), F.col("event_type").alias("kind"), F.floor("value").cast("long").alias("size"))
    return e.where("id <> 0")


@query(f"SELECT id, max(idx) AS idx, arg_max(kind, idx) AS kind, arg_max(size, idx) AS size FROM {DICT} GROUP BY id")
def last_wins(t: Tables) -> DataFrame:
    """The dictionary: the last definition of an id holds; id 0 is ignored."""
    return k.first_wins(entries(t), ["id"], "idx", last=True)


@query(f"SELECT id, idx, idx < max(idx) OVER (PARTITION BY id) AS shadowed FROM {DICT}")
def shadowed_flag(t: Tables) -> DataFrame:
    """Every definition, with those flagged that a later one shadows."""
    return k.flag_shadowed(entries(t), ["id"], "idx").select("id", "idx", "shadowed")


@query(f"SELECT id, min(idx) AS idx, arg_min(kind, idx) AS kind, arg_min(size, idx) AS size FROM {DICT} GROUP BY id")
def first_wins(t: Tables) -> DataFrame:
    """The first row of an id holds."""
    return k.first_wins(entries(t), ["id"], "idx")


@query(f"SELECT id, kind, arg_min(size, idx) AS size FROM {DICT} GROUP BY ALL")
def lowest_index(t: Tables) -> DataFrame:
    """Per code the glyph at the lowest index."""
    return k.extreme_value(entries(t), ["id", "kind"], "size", "idx")


@query("SELECT p_brand AS id, min(p_name) AS name FROM part GROUP BY ALL")
def reverse_export(t: Tables) -> DataFrame:
    """Per id the smallest of its exported names."""
    return t.part.groupBy(F.col("p_brand").alias("id")).agg(F.min("p_name").alias("name"))


@query(f"SELECT id, kind, min(idx) AS idx, arg_min(size, idx) AS size FROM {DICT} GROUP BY ALL")
def evidence_dedupe(t: Tables) -> DataFrame:
    """The first row of each signature (id, kind)."""
    return k.dedupe(entries(t), ["id", "kind"], "idx")


@query("SELECT text, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    """Texts that occur more than once."""
    return k.duplicate_keys(t.documents, ["text"]).select("text", "n")


@query("SELECT sha256(text) AS form, count(*) AS n, count(DISTINCT source) AS spread FROM documents WHERE lang <> 'es' GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT source) > 1")
def hoist_groups(t: Tables) -> DataFrame:
    """Equal forms with more than one member in more than one place, outside the excluded class."""
    return k.group_by_form(t.documents.where("lang <> 'es'"), F.col("text"), "source").where("n > 1 and spread > 1")


@query("SELECT id, CASE WHEN id < 3 THEN min(event_id) ELSE max(event_id) END AS idx FROM (SELECT event_id % 7 AS id, event_id FROM events) GROUP BY id")
def mixed_wins(t: Tables) -> DataFrame:
    """First row or last row per key, as the key's kind asks."""
    e = t.events.select((F.col("event_id") % 7).alias("id"), F.col("event_id").alias("idx"))
    return e.groupBy("id").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi")).select("id", F.when(F.col("id") < 3, F.col("lo")).otherwise(F.col("hi")).alias("idx"))

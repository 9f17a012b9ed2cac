"""All named queries of the engine."""

from sparkloom.plans import aggregates, containers, diffs, folding, folds, graphs, keyed, lookups, media, names, numeric, ranges, reports, signals, tagfields, text, timeline  # noqa: F401
from sparkloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

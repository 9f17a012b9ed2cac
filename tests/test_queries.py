"""Every query against its SQL, run by DuckDB over the same tables."""

import math
import os

import duckdb
import pytest

from sparkloom.plans.catalog import ORACLE_SQL, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        return plain(value.item())
    return round(value, 9) if isinstance(value, float) else value


def table(frame):
    columns = sorted(frame.columns)
    frame = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted((tuple(plain(v) for v in row) for row in frame.itertuples(index=False)), key=repr)


def same(a, b):
    """Equal rows, where whole numbers may be doubles on either side."""
    return len(a) == len(b) and all(len(x) == len(y) and all(p == q for p, q in zip(x, y)) for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, duck, name):
    got_columns, got = table(QUERIES[name](spark, FOLDER).toPandas())
    want_columns, want = table(duck.sql(ORACLE_SQL[name]).df())
    assert got_columns == want_columns
    assert same(got, want) or sorted(map(str, got)) == sorted(map(str, want))


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)

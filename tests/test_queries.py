"""Every query against its DuckDB oracle on the smallest tables."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAMILY = {"tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int", "hugeint": "int", "float": "float", "double": "float", "string": "text", "varchar": "text"}


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    kinds = dict(df.dtypes)
    for c, k in zip(want.columns, want.types):
        k = str(k).lower()
        assert FAMILY.get(kinds[c], kinds[c].split("<")[0]) == FAMILY.get(k, "array" if k.endswith("[]") else "float" if k.startswith("decimal") and kinds[c] == "double" else k) or kinds[c] in ("void", "timestamp_ntz"), c


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith("op") and n != "pipeline"))
def test_without_oracle(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists(os.path.join(os.path.dirname(entry.__file__), "bench.py"))

"""Each query against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

QUERIES, SQL = contract.queries(), contract.oracle_sql()
OWN = [n for n in QUERIES if not n.startswith(("op", "pipeline")) or n == "oversize_counts"]

#: Queries that must find nothing.
EMPTY = ("bm25_void_query", "bm25_no_terms")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def normal(rows):
    fix = lambda x: None if isinstance(x, float) and math.isnan(x) else x
    return sorted((tuple(fix(x) for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", [n for n in OWN if n in SQL])
def test_same_rows(spark, sf_dir, duck, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    assert normal(frame.select(columns).collect()) == normal(want)
    assert want or name in EMPTY  # two empty results agree on nothing


@pytest.mark.parametrize("name", [n for n in OWN if n not in SQL])
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0

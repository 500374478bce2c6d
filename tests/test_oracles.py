"""Every registered query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from tessera.plans.registry import load

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "none"
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return str(value)


def rows(table):
    names = sorted(table.column_names)
    return sorted(tuple(map(plain, r)) for r in zip(*(table.column(n).to_pylist() for n in names), strict=True)), names


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    got, want = rows(QUERIES[name](spark, SF).toArrow()), rows(duck.sql(ORACLES[name]).to_arrow_table())
    assert got[1] == want[1]
    assert got[0] == want[0]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0

"""The queries against their DuckDB SQL."""

import duckdb
import pytest
from tests.llm.conftest import SMALL, rows

from tessera.llm import neardup, quality, substring
from tessera.llm.oracles import near_duplicates
from tessera.llm.queries import ORACLES, QUERIES


def told(sql, **tables):
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'") if name not in tables else con.register(name, tables[name])
    out = con.sql(sql)
    return out.columns, out.fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    columns, want = told(ORACLES[name])
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.select(*columns)) == sorted(want, key=repr)


def test_sql_of_odd_texts(spark, odd):
    """Nulls, empty texts and odd characters; ids once each, as in the tables."""
    table = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    arrow = table.toArrow()
    for name, run in (("op6_quality", lambda d: quality.clean_lines(d, with_text=False)), ("op9_neardup", neardup.digests), ("op10_substring", substring.remove)):
        columns, want = told(ORACLES[name], documents=arrow)
        assert rows(run(table).select(*columns)) == sorted(want, key=repr), name


def test_sql_of_five_words(spark, docs):
    columns, want = told(near_duplicates(5, 80))
    assert rows(neardup.digests(docs, neardup.Forest(words=5)).select(*columns)) == sorted(want, key=repr)

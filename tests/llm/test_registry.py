"""Queries with SQL give the same rows as DuckDB over the same tables."""

import duckdb
import pytest

import __spark_entry__ as E
from turnscore.llm.registry import QUERIES, SQL
from tests.conftest import SF01

TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_all_registered():
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    df = QUERIES[name](spark, SF01)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]}) AS q").fetchall()
    assert sorted(c[0] for c in con.execute(f"DESCRIBE {SQL[name]}").fetchall()) == columns
    assert got == sorted(want, key=repr)

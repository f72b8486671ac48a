"""Every registered query runs on sf0.001 with a stable schema, and matches its
DuckDB oracle (row count, column names, values) where one is given."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF001
from turnscore.plans.registry import REGISTRY

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(rows):
    return sorted((tuple(_norm(x) for x in rec) for rec in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT"}


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql])
def test_column_types_match_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in df.schema.fields}
    duck_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {E.oracle_sql()[name]}").fetchall()}
    assert spark_types == duck_types


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "strict_acc" in df.columns


@pytest.mark.parametrize("name", [n for n in REGISTRY if n not in ("text_regression_cv", "gbt_regression_cv")])
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    cols = sorted(df.columns)
    sdf = df.select(*cols).collect()
    sql = E.oracle_sql().get(name)
    if sql is None:
        return
    assert cols == sorted(r[0] for r in con.execute(f"DESCRIBE {sql}").fetchall())
    odf = con.execute(f"SELECT {', '.join(cols)} FROM ({sql}) AS q").fetchall()
    assert len(sdf) == len(odf)
    a, b = _rows(sdf), _rows(odf)
    if a != b:  # doubles may straddle a rounding tie when summation order differs
        for x, y in zip(a, b):
            for u, v in zip(x, y):
                if isinstance(u, float) and isinstance(v, float):
                    assert abs(u - v) <= 2e-6, (x, y)
                else:
                    assert u == v, (x, y)

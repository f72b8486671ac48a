"""Registry of named queries: a Spark builder and (when SQL-expressible) its
DuckDB oracle. ``__spark_entry__`` exposes this registry to the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DECIMALS = 6


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: str  # SURVEY operator ids covered


REGISTRY: dict[str, Query] = {}


def register(name: str, ids: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, ids)
        return fn
    return deco


def round_doubles(df: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    """Round every DOUBLE column (and normalise -0.0) for engine-independent hashes."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            scale = F.lit(float(10 ** decimals))
            # round(x * 10^d) / 10^d in IEEE steps, as DuckDB's round(x, d) does
            cols.append((F.round(F.col(f.name).cast("double") * scale, 0) / scale + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def round_sql(inner: str, cols: list[str], decimals: int = DECIMALS) -> str:
    """Wrap a DuckDB query so the named DOUBLE columns are rounded like ``round_doubles``."""
    rep = ", ".join(f"round(CAST({c} AS DOUBLE), {decimals}) + 0e0 AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{inner}\n) AS q"

"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscore.session import materialize, release

__all__ = ["materialize", "release", "read_table", "ship", "text_or_empty", "hash_bitmap", "split_likely", "renamed", "connected_components"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(module: str) -> None:
    """Send the functions of ``module`` to the Python workers by value, so that
    executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def renamed(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns named c0, c1, ..., so that none clashes with what an operator adds, and the new
    names of ``names``. ``toDF`` with the old names undoes it."""
    new = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*new), [new[docs.columns.index(n)] for n in names]


def hash_bitmap(df: DataFrame, col: str, bits: int) -> np.ndarray:
    """Which values modulo ``bits`` (a multiple of 2**15) the column has, as packed little-endian
    bits. Its size is ``bits`` whatever the data: a filter that may pass too much, never too little."""
    out = np.zeros(bits // 8, np.uint8)
    for r in (df.select((F.pmod(col, F.lit(bits)) + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).toLocalIterator()):
        out[(r.b - 1) * 4096:r.b * 4096] = np.frombuffer(bytes(r.m), np.uint8)
    return out


def split_likely(docs: DataFrame, key: Column, wanted: DataFrame, wanted_col: str, bits: int = 1 << 23) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` may be in ``wanted``, rows whose key is surely not), so that only the first
    need a join that shuffles them. The bitmap in between has bits / 2**15 rows of 4 KB, whatever the data."""
    p = F.pmod(F.col(wanted_col), F.lit(bits)) + 1
    rows = materialize(wanted.select(p.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_bm_bucket"))
                       .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bm_bits")), "bitmap")
    place = F.pmod(key, F.lit(bits))
    byte = F.conv(F.hex(F.substr("_bm_bits", (F.floor(place % 32768 / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (place % 8).cast("int")), F.lit(0)) == 1
    marked = docs.join(F.broadcast(rows), F.floor(place / 32768) + 1 == F.col("_bm_bucket"), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return marked.where(hit).select(*columns), marked.where(~hit).select(*columns)


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 64) -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``edges``.

    Alternating large-star and small-star rounds. Each round aggregates with
    map-side combining and joins the minimum back, so a node with very many
    neighbours is split like any other skewed join; every round is written to
    the shared folder, and only two sums come back to the driver. Self-links and
    rows with a null end are ignored; a node without links gets no row."""
    e = (edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
         .where("u is not null and v is not null and u <> v")
         .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    e = materialize(e, "cc")
    last = None
    for _ in range(max_rounds):
        # large star: every larger neighbour is linked to the smallest one
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large, before = materialize(large, "cc"), e
        # small star: the node and its smaller neighbours are linked to the smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = (small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
             .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = materialize(e, "cc")
        release(large), release(before)
        mark = e.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first()
        if mark == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        last = mark
    raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")


ship(__name__)  # modules that are sent by value hold functions of this one

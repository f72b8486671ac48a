"""The processed-subject ledger as one snapshot and the batches after it.

A batch appends its subjects to a folder ``batch_id=N`` below the ledger's path (a replay overwrites it).
Every ``KEEP`` batches the ledger so far becomes a snapshot ``upto=N`` beside it; Spark's _SUCCESS
file is its commit marker, so a snapshot that a crash left unfinished is not read and is
written again later. A reader takes the latest complete snapshot and the batch folders
behind it, at most 2 * KEEP of them however many batches there were. Folders that an older
snapshot already holds are deleted. Subjects registered outside the stream (``batch_id=-1``) are no
part of snapshots and are always read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscore import schemas as S

KEEP = 16


def _folders(spark: SparkSession, path: str, name: str, complete: bool = False) -> dict[int, str]:
    """Sub-folders ``name=N`` of a folder by N, only names listed; with ``complete`` those that have a commit marker."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return {}
    out = {}
    for f in fs.listStatus(root):
        m = re.fullmatch(rf"{name}=(-?\d+)", f.getPath().getName())
        if m and (not complete or fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))):
            out[int(m[1])] = f.getPath().toString()
    return out


def snapshot_path(path: str) -> str:
    return f"{path.rstrip('/')}_snapshots"


def read(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The ledger (``S.LEDGER``) as of the batches before ``before`` (all without it)."""
    below = float("inf") if before is None else before
    taken = max((n for n in _folders(spark, snapshot_path(path), "upto", complete=True) if n < below), default=None)
    batches = {n: p for n, p in _folders(spark, path, "batch_id").items() if n < below and (n < 0 or taken is None or n > taken)}
    out = spark.createDataFrame([], S.LEDGER)
    if taken is not None:
        out = out.unionByName(spark.read.schema(S.LEDGER).parquet(f"{snapshot_path(path)}/upto={taken}").select(*S.LEDGER.names))
    if batches:
        rows = spark.read.option("basePath", path).schema(S.LEDGER).parquet(*batches.values())
        out = out.unionByName(rows.select(*S.LEDGER.names))
    return out


def append(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write a batch's rows (subject, processed_at); every KEEP batches a snapshot follows."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    if (batch_id + 1) % KEEP == 0:
        compact(rows.sparkSession, path, batch_id)


def compact(spark: SparkSession, path: str, upto: int) -> None:
    """Snapshot of the batches 0 to ``upto``; then folders of batches and snapshots that the previous one makes
    needless are deleted. A replay of batch ``upto`` still finds the state before it."""
    before = max((n for n in _folders(spark, snapshot_path(path), "upto", complete=True) if n < upto), default=None)
    rows = read(spark, path, upto + 1).where(F.col("batch_id") >= 0)
    rows.groupBy("subject").agg(F.min("processed_at").alias("processed_at"), F.min("batch_id").alias("batch_id")) \
        .write.mode("overwrite").parquet(f"{snapshot_path(path)}/upto={upto}")
    if before is None:
        return
    jvm = spark._jvm
    old = [p for n, p in _folders(spark, path, "batch_id").items() if 0 <= n <= before]
    old += [p for n, p in _folders(spark, snapshot_path(path), "upto").items() if n < before]
    for p in old:
        gone = jvm.org.apache.hadoop.fs.Path(p)
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

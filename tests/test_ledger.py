"""The ledger as snapshot and batches."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from turnscore.sources import ledger as LG
from turnscore.sources import readers as R


@pytest.fixture
def path():
    return f"{tempfile.mkdtemp(prefix='turnscore-ledger-')}/ledger"


def rows(spark, *subjects):
    return spark.createDataFrame([(s,) for s in subjects], "subject STRING").withColumn("processed_at", F.current_timestamp())


def subjects(df):
    return sorted((r.subject, r.batch_id) for r in df.collect())


def test_reads_stay_bounded(spark, path, monkeypatch):
    monkeypatch.setattr(LG, "KEEP", 3)
    rows(spark, "out").write.parquet(f"{path}/batch_id=-1")
    for b in range(14):
        LG.append(rows(spark, f"s{b}"), path, b)
        assert subjects(LG.read(spark, path)) == sorted([("out", -1), *((f"s{i}", i) for i in range(b + 1))])
        assert len(LG._folders(spark, path, "batch_id")) <= 2 * 3 + 1
        assert len(LG._folders(spark, LG.snapshot_path(path), "upto")) <= 2
    assert subjects(R.read_ledger(spark, path)) == subjects(LG.read(spark, path))
    # a batch sees what was there before it, also where a snapshot ends with it
    assert subjects(LG.read(spark, path, before=11)) == sorted([("out", -1), *((f"s{i}", i) for i in range(11))])


def test_crash_between_data_and_marker(spark, path, monkeypatch):
    monkeypatch.setattr(LG, "KEEP", 2)
    for b in range(4):
        LG.append(rows(spark, f"s{b}"), path, b)
    os.remove(f"{LG.snapshot_path(path)}/upto=3/_SUCCESS")
    assert subjects(LG.read(spark, path)) == [(f"s{i}", i) for i in range(4)]
    LG.append(rows(spark, "s3"), path, 3)  # the batch is replayed
    assert os.path.exists(f"{LG.snapshot_path(path)}/upto=3/_SUCCESS")
    LG.append(rows(spark, "s4"), path, 4)
    assert subjects(LG.read(spark, path)) == [(f"s{i}", i) for i in range(5)]


def test_nothing_yet(spark, path):
    assert LG.read(spark, path).count() == 0

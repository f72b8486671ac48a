"""Session construction and shared-storage helpers.

Library code never builds its own session: every operator takes a DataFrame
and returns a DataFrame. ``build_session`` is for tests, the bench and the
command line only.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "turnscore", extra: dict | None = None) -> SparkSession:
    master = master or os.environ.get("TURNSCORE_MASTER", "local[*]")
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TURNSCORE_DRIVER_MEMORY", "16g"))
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names shared storage and is used as is. Only
    when it is unset on a local master (tests) a folder of our own is created
    and set: elsewhere executors would write to disks of their own.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="turnscore-ckpt-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder for a written intermediate table."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/turnscore-{name}-{uuid.uuid4().hex}"


def materialize(df, name: str = "table"):
    """Compute ``df`` once into a parquet table below ``spark.checkpoint.dir`` and
    read it back: a derived table referenced by several branches of a plan is
    not recomputed per branch, its lineage is cut, and it survives the loss of
    the executors that computed it (the files are in shared storage)."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    out._shared_path = path
    return out


def release(df) -> None:
    """Delete the files of a ``materialize`` result that nothing reads any more."""
    path = getattr(df, "_shared_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def recommended_conf(input_bytes: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Settings for a large cluster, sized from the input volume: ~256 MB scan
    splits and shuffle partitions (AQE coalesces small ones and splits skewed
    ones at run time; joins are converted to broadcast only when the runtime
    size of a side is below the threshold)."""
    parts = max(200, int(input_bytes // target_partition_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        # per-fold model fits are submitted concurrently from driver threads
        "spark.scheduler.mode": "FAIR",
    }

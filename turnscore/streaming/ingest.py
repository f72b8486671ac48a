"""Incremental ingest with a processed-subject ledger (Structured Streaming).

A file-source stream is processed with ``foreachBatch``:
  1. drop rows of subjects already in the ledger (left-anti join; the ledger
     is read as of the batches *before* this one, so a replayed batch sees
     the same ledger),
  2. write the batch's rows to ``<sink>/batch_id=<id>`` (overwrite: a replay
     replaces, never duplicates),
  3. append the batch's subjects to ``<ledger>/batch_id=<id>`` (overwrite too); every few
     batches the ledger becomes a snapshot, so a batch reads one and the folders since.
The stream's checkpoint records committed batch ids, so a restarted job
continues after the last committed batch. Data are written before the ledger,
so a failure between the two never marks an unwritten subject as done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from turnscore.operators.turns import merge_turns
from turnscore.sources import ledger


def pending(manifest: DataFrame, ledger: DataFrame, key: str = "subject") -> DataFrame:
    """Manifest rows whose subject is not yet in the ledger (JO1 / FI2 / FI3)."""
    return manifest.join(ledger.select(key).distinct(), key, "left_anti")


def without_output(manifest: DataFrame, outputs: DataFrame, expected, path: str = "path") -> DataFrame:
    """Manifest rows whose expected output (a Column) is not among the listed outputs (FI3)."""
    done = outputs.select(F.col(path).alias("_done")).distinct()
    return manifest.withColumn("_expected", expected).join(done, F.col("_expected") == F.col("_done"), "left_anti").drop("_expected")


def ledger_batch_writer(ledger_path: str, sink_path: str, key: str = "subject",
                        transform: Callable[[DataFrame], DataFrame] | None = None):
    """The ``foreachBatch`` function of SS1. ``transform`` keeps the ``key`` column."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = ledger.read(spark, ledger_path, before=batch_id)
        fresh = pending(batch, before, key)
        out = transform(fresh) if transform is not None else fresh
        out.write.mode("overwrite").parquet(f"{sink_path}/batch_id={batch_id}")
        # from what was written: the source and the ledger are not read again
        done = spark.read.parquet(f"{sink_path}/batch_id={batch_id}").select(key).distinct()
        ledger.append(done.withColumn("processed_at", F.current_timestamp()), ledger_path, batch_id)
    return run


def ingest_stream(stream: DataFrame, ledger_path: str, sink_path: str, checkpoint: str,
                  key: str = "subject", transform: Callable[[DataFrame], DataFrame] | None = None,
                  available_now: bool = True):
    """Start the ingest query (SS1); with ``available_now`` it processes every
    file present and stops. Returns the StreamingQuery."""
    w = stream.writeStream.foreachBatch(ledger_batch_writer(ledger_path, sink_path, key, transform)) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def _bucket(bucket_count: int):
    return F.pmod(F.xxhash64("subject"), F.lit(bucket_count)).cast("int")


def append_turns(batch: DataFrame, turns_path: str, batch_id: int, bucket_count: int) -> list[int]:
    """Store a batch's turns by subject bucket (SK7; a replay overwrites its own folder) and return
    the touched buckets: at most ``bucket_count`` numbers."""
    path = f"{turns_path}/batch_id={batch_id}"
    batch.withColumn("sbucket", _bucket(bucket_count)).write.mode("overwrite").partitionBy("sbucket").parquet(path)
    return [r.sbucket for r in batch.sparkSession.read.parquet(path).select("sbucket").distinct().collect()]


def merge_touched(spark: SparkSession, turns_path: str, merged_path: str, buckets: list[int], schema, bucket_count: int) -> None:
    """SS2: re-merge the full history of the touched subject buckets and overwrite only them.
    The store is partitioned by bucket, so the other buckets' files are not read."""
    turns = spark.read.schema(schema).parquet(turns_path).where(F.col("sbucket").isin(buckets))
    merged = merge_turns(turns.select("subject", "speaker", "text", "seq"), order="subject")
    merged.withColumn("sbucket", _bucket(bucket_count)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("sbucket").parquet(merged_path)


def merge_stream(stream: DataFrame, turns_path: str, merged_path: str, checkpoint: str, bucket_count: int = 1024):
    """SS2 as a query over a stream of (subject, speaker, text, seq): every batch appends its turns and
    re-merges the subject buckets it touched."""
    schema = StructType([*stream.schema.fields, StructField("batch_id", LongType()), StructField("sbucket", IntegerType())])

    def run(batch: DataFrame, batch_id: int) -> None:
        buckets = append_turns(batch, turns_path, batch_id, bucket_count)
        if buckets:
            merge_touched(batch.sparkSession, turns_path, merged_path, buckets, schema, bucket_count)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

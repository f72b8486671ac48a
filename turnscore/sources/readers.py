"""Readers: explicit schemas everywhere, no inference, splittable formats.

Excel workbooks of the study become parquet / CSV tables; row order, which the
study leaves implicit in the file, becomes an explicit ``seq`` column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnscore import schemas as S
from turnscore.sources import ledger
from turnscore.functions.ordinal import nan_to_null
from turnscore.functions.text import subject_key


def with_source_order(df: DataFrame, col: str = "seq") -> DataFrame:
    """Dense 0-based row position in source order (file, then position in file).

    Must be applied directly on a scan (no shuffle before it). Rows are grouped
    by (file, input partition) - the upper bits of ``monotonically_increasing_id``
    - whose sizes give offsets (one row per input split); positions
    inside a split come from the id's lower bits. Persist the result: the
    position is the order of the files as listed."""
    d = df.withColumn("_file", F.input_file_name()).withColumn("_mid", F.monotonically_increasing_id())
    d = d.withColumn("_split", F.shiftright("_mid", 33)).withColumn("_fh", F.xxhash64("_file"))
    from pyspark.sql import Window
    sizes = d.groupBy("_file", "_fh", "_split").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_min"))
    # one row per (file, input split): the only rows this window sees
    running = Window.orderBy("_file", "_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_fh", "_split", "_min",
                           F.coalesce(F.sum("_cnt").over(running), F.lit(0)).alias("_off"))
    # one row of four longs per (file, input split); Spark broadcasts it if it measures small
    out = d.join(offsets, ["_fh", "_split"])
    return out.withColumn(col, (F.col("_off") + F.col("_mid") - F.col("_min")).cast("bigint")) \
        .drop("_file", "_fh", "_mid", "_split", "_min", "_off")


def read_table(spark: SparkSession, path: str | Sequence[str], schema: T.StructType,
               fmt: str = "parquet", header: bool = True, multi_line: bool = False) -> DataFrame:
    """Explicit-schema scan. CSV stays splittable unless ``multi_line`` (quoted
    line breaks) is asked for, which makes every file one partition."""
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.option("header", header).option("multiLine", multi_line).option("escape", '"').csv(paths)
    if fmt == "json":
        return reader.json(paths)
    return reader.format(fmt).load(paths)


def read_turns(spark: SparkSession, path, fmt: str = "parquet", seq: str | None = "seq") -> DataFrame:
    """Turn table (SC1): three positional columns subject, speaker, text, plus
    ``seq`` read from the source or, when ``seq`` is None, derived from source order."""
    if seq:
        df = read_table(spark, path, S.TURNS, fmt)
        return df.select("subject", "speaker", "text", F.col(seq).cast("bigint").alias("seq"))
    three = T.StructType(S.TURNS.fields[:3])
    df = read_table(spark, path, three, fmt).toDF("subject", "speaker", "text")
    return with_source_order(df)


def read_scored_turns(spark: SparkSession, path, fmt: str = "parquet") -> DataFrame:
    """Scored turns (SC2); a NaN score becomes null."""
    df = read_table(spark, path, S.SCORED_TURNS, fmt)
    return df.withColumn("score", nan_to_null(F.col("score")))


def read_text_pairs(spark: SparkSession, real_path, synthetic_path, fmt: str = "parquet",
                    text: str = "text", score: str = "score") -> DataFrame:
    """Two collections stacked with a ``synthetic`` flag (SC3); rows null in text
    or score dropped (FI4)."""
    schema = T.StructType([T.StructField(text, T.StringType()), T.StructField(score, T.DoubleType())])
    real = read_table(spark, real_path, schema, fmt).withColumn("synthetic", F.lit(False))
    syn = read_table(spark, synthetic_path, schema, fmt).withColumn("synthetic", F.lit(True))
    both = real.unionByName(syn).withColumn(score, nan_to_null(F.col(score)))
    return both.dropna(subset=[text, score])


def read_examples(spark: SparkSession, path) -> DataFrame:
    """JSONL examples (SC4): input, output."""
    return spark.read.schema(S.EXAMPLES).json(path)


def read_confusion_doc(spark: SparkSession, path) -> DataFrame:
    """Confusion document(s) (SC5) -> long (topic, rule, true_score, pred_score, n)."""
    from turnscore.operators.confusion import explode_document
    docs = spark.read.option("wholetext", True).text(path)
    return explode_document(docs, "value")


def read_learning_curve(spark: SparkSession, path) -> DataFrame:
    """Learning-curve CSV (SC6)."""
    return read_table(spark, path, S.LEARNING_CURVE, "csv")


def media_manifest(spark: SparkSession, root: str, folder_prefix: str = "MC_1",
                   suffix: str = "_MADRS.mp4") -> DataFrame:
    """Recording manifest (SC7): files below ``root`` whose name ends with
    ``suffix`` inside a folder starting with ``folder_prefix``. File contents are
    never read (the ``content`` column is pruned from the scan)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True) \
        .option("pathGlobFilter", f"*{suffix}").load(f"{root.rstrip('/')}/{folder_prefix}*")
    return df.select("path", "length", "modificationTime") \
        .withColumn("file_name", F.element_at(F.split(F.col("path"), "/"), -1)) \
        .withColumn("subject", subject_key(F.col("file_name")))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Processed-subject ledger (SC8): subject, processed_at and the ``batch_id`` whose folder held
    the row (batch registration writes to one below 0); an empty frame when there is none yet.
    Reads one snapshot and the batches behind it (``sources.ledger``)."""
    return ledger.read(spark, path)


def read_segments(spark: SparkSession, path, fmt: str = "parquet") -> DataFrame:
    """Diarization segments (subject, speaker, start_s, end_s) - the input of the
    millisecond keys (PR4, PR5) and of the interval alignment (JO8)."""
    return read_table(spark, path, S.SEGMENTS, fmt)


def read_rubric(spark: SparkSession, path, fmt: str = "json") -> DataFrame:
    """Rubric dimension (topic, score, description, criterion) for ``rubric_lookup``."""
    return read_table(spark, path, S.RUBRIC, fmt)

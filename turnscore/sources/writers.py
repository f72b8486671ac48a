"""Sinks: parquet / JSON lines / CSV / text, written by the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    """SK1 / SK6: one table, optionally partitioned, optionally sorted (SO1: the
    only place a global order is produced)."""
    w = (df.orderBy(*sort_by) if sort_by else df).write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":  # RFC 4180 quoting (doubled quotes), as the readers expect
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)


def write_examples(examples: DataFrame, path: str, mode: str = "overwrite",
                   sort_by: Sequence[str] = ()) -> None:
    """SK2: JSON lines with keys input, output (UTF-8, not ASCII-escaped).
    ``sort_by`` (e.g. subject, topic - SO1) orders the files and lines: a
    range-partitioned sort, done only here at the sink."""
    out = examples.orderBy(*sort_by) if sort_by else examples
    out.select("input", "output").write.mode(mode).json(path)


def write_predictions(preds: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SK3: row-form predictions partitioned by model."""
    preds.write.mode(mode).partitionBy("model").parquet(path)


def write_confusion_docs(docs: DataFrame, path: str, by: str = "model", mode: str = "overwrite") -> None:
    """SK4: one JSON document per ``by`` value (``confusion_document`` output)."""
    docs.select(by, "doc").write.mode(mode).partitionBy(by).text(path)


def write_lines(lines: DataFrame, path: str, col: str = "line", mode: str = "overwrite") -> None:
    """SK5: report lines as text files (ordering columns, if any, decide file order)."""
    lines.select(F.col(col).alias("value")).write.mode(mode).text(path)


#: Batch registration's folder among the ``batch_id`` folders that streams write.
BATCH_FOLDER = -1


def append_rows(df: DataFrame, path: str, batch_id: int = BATCH_FOLDER) -> None:
    """SK7 / SK8: append rows to a table of ``batch_id`` folders (created on first write)."""
    df.write.mode("append").parquet(f"{path}/batch_id={batch_id}")


def save_model(model, path: str) -> None:
    """SK9: fitted Spark ML model to (shared) storage, replacing an older one."""
    model.write().overwrite().save(path)

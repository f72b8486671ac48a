"""Dense 7x7 confusion matrices per topic for the strict and flexible rules,
their traces, and the JSON document form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscore import schemas as S
from turnscore.functions.ordinal import to_ordinal, tolerant

RULES = ("strict", "flexible")


def with_rules(preds: DataFrame, label: str = "label", pred: str = "pred",
               tol: int = S.TOLERANCE) -> DataFrame:
    """Adds ``strict`` (rounded, clipped) and ``flexible`` (label when within tol)."""
    strict = to_ordinal(F.col(pred))
    return preds.withColumn("strict", strict) \
        .withColumn("flexible", tolerant(F.col("strict"), F.col(label).cast("int"), tol))


def confusion(preds: DataFrame, topic_dim: DataFrame, by: Sequence[str] = ("model",),
              topic: str = "topic", label: str = "label", pred: str = "pred",
              tol: int = S.TOLERANCE) -> DataFrame:
    """Long dense form: (by..., topic, rule, true_score, pred_score, n) for every
    evaluated topic present in the data, rule, and 0..6 x 0..6 cell.

    One aggregation for both rules (explode of two structs); labels or
    predictions outside 0..6 are ignored. The topic filter is a broadcast join
    with the fixed 9-row dimension."""
    by = list(by)
    d = with_rules(preds.withColumnRenamed(topic, "topic"), label, pred, tol) \
        .join(F.broadcast(topic_dim.select("topic")), "topic")  # fixed 9 rows
    y = F.col(label).cast("int")
    both = F.explode(F.array(
        F.struct(F.lit("strict").alias("rule"), F.col("strict").alias("p")),
        F.struct(F.lit("flexible").alias("rule"), F.col("flexible").alias("p"))))
    cells = d.where(y.between(S.SCORE_MIN, S.SCORE_MAX)).select(*by, "topic", y.alias("true_score"),
                                                                both.alias("x")) \
        .select(*by, "topic", F.col("x.rule").alias("rule"), "true_score", F.col("x.p").alias("pred_score")) \
        .where(F.col("pred_score").between(S.SCORE_MIN, S.SCORE_MAX))
    counts = cells.groupBy(*by, "topic", "rule", "true_score", "pred_score").agg(F.count(F.lit(1)).alias("n"))
    # at most 2 x 49 cells per group: gathered into a map and looked up, so nothing is scanned or joined again
    cell = F.concat_ws(":", "rule", "true_score", "pred_score")
    group = counts.groupBy(*by, "topic").agg(F.map_from_entries(F.collect_list(F.struct(cell, "n"))).alias("cells"))
    scores = F.sequence(F.lit(S.SCORE_MIN), F.lit(S.SCORE_MAX))
    spine = group.withColumn("rule", F.explode(F.array(*[F.lit(r) for r in RULES]))) \
        .withColumn("true_score", F.explode(scores)).withColumn("pred_score", F.explode(scores))
    return spine.select(*by, "topic", "rule", "true_score", "pred_score",
                        F.coalesce(F.try_element_at("cells", cell), F.lit(0)).cast("bigint").alias("n"))


def trace(dense: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """correct = trace, total = sum, errors = total - trace, per (by, topic, rule)."""
    return dense.groupBy(*by, "topic", "rule").agg(
        F.sum(F.when(F.col("true_score") == F.col("pred_score"), F.col("n")).otherwise(0))
        .cast("bigint").alias("correct"),
        F.sum("n").cast("bigint").alias("total")) \
        .withColumn("errors", F.col("total") - F.col("correct"))


def confusion_document(dense: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """One row per ``by`` group with ``doc`` = JSON
    ``{topic: {rule: [[n(true=i, pred=j) for j] for i]}}`` (49 cells per matrix)."""
    by = list(by)
    mats = dense.groupBy(*by, "topic", "rule").agg(
        F.array_sort(F.collect_list(F.struct("true_score", "pred_score", "n"))).alias("cells"))
    flat = F.transform("cells", lambda c: c["n"])
    matrix = F.transform(F.sequence(F.lit(0), F.lit(S.SCORE_MAX - S.SCORE_MIN)),
                         lambda i: F.slice(flat, i * 7 + 1, 7))
    per_topic = mats.groupBy(*by, "topic").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", matrix.alias("m")))).alias("rules"))
    return per_topic.groupBy(*by).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("topic", "rules")))).alias("doc"))


def explode_document(docs: DataFrame, doc_col: str = "doc", by: Sequence[str] = ()) -> DataFrame:
    """Inverse of ``confusion_document``: JSON doc -> long (topic, rule, true, pred, n)."""
    parsed = docs.select(*by, F.from_json(F.col(doc_col), S.CONFUSION_DOC).alias("d"))
    t = parsed.select(*by, F.explode("d").alias("topic", "rules"))
    r = t.select(*by, "topic", F.explode("rules").alias("rule", "m"))
    rows = r.select(*by, "topic", "rule", F.posexplode("m").alias("true_score", "row"))
    return rows.select(*by, "topic", "rule", "true_score",
                       F.posexplode("row").alias("pred_score", "n"))

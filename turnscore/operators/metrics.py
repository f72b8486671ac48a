"""Ordinal-regression evaluation: metrics per slice, fold summaries, mean baselines.

Every metric is a declarative aggregate, so Spark combines partial aggregates
map-side and a hot topic or fold costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnscore import schemas as S
from turnscore.functions.ordinal import to_ordinal

METRIC_NAMES = ["mse", "mae", "strict_acc", "tolerant_acc"]
ALL = "ALL"


def regression_metrics(label: str = "label", pred: str = "pred",
                       tol: int = S.TOLERANCE) -> list[Column]:
    """MSE and MAE on the continuous prediction; strict and within-``tol`` accuracy
    on the rounded (half-even) prediction clipped to 0..6. Also the slice size ``n``."""
    y = F.col(label).cast("double")
    p = F.col(pred).cast("double")
    strict = to_ordinal(p)
    y_int = F.col(label).cast("int")
    hit = F.when(strict == y_int, F.lit(1.0)).otherwise(F.lit(0.0))
    near = F.when(F.abs(strict - y_int) <= F.lit(tol), F.lit(1.0)).otherwise(F.lit(0.0))
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.pow(p - y, F.lit(2.0))).alias("mse"),
        F.avg(F.abs(p - y)).alias("mae"),
        F.avg(hit).alias("strict_acc"),
        F.avg(near).alias("tolerant_acc"),
    ]


def evaluate(df: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred",
             metrics: Sequence[Column] | None = None, tol: int = S.TOLERANCE) -> DataFrame:
    """One row of metrics per group of ``by`` (the whole frame when empty)."""
    aggs = list(metrics) if metrics is not None else regression_metrics(label, pred, tol)
    return df.groupBy(*by).agg(*aggs)


def evaluate_folds(df: DataFrame, keys: Sequence[str] = ("model",), fold: str = "fold",
                   topic: str = "topic", label: str = "label", pred: str = "pred",
                   tol: int = S.TOLERANCE) -> DataFrame:
    """Metrics per (keys, fold) overall and per (keys, fold, topic) in ONE pass
    (grouping sets). Overall rows carry topic = 'ALL'."""
    base = [*keys, fold]
    grouped = df.groupingSets([base, [*base, topic]], *base, topic)
    out = grouped.agg(*regression_metrics(label, pred, tol),
                      F.grouping(F.col(topic)).alias("_all"))
    return out.withColumn(topic, F.when(F.col("_all") == 1, F.lit(ALL)).otherwise(F.col(topic))) \
        .drop("_all")


def metrics_long(fold_metrics: DataFrame, ids: Sequence[str],
                 metrics: Sequence[str] = METRIC_NAMES) -> DataFrame:
    """Wide metric columns -> rows (ids..., metric, value)."""
    return fold_metrics.unpivot(list(ids), list(metrics), "metric", "value")


def cross_fold(fold_metrics: DataFrame, keys: Sequence[str] = ("model", "topic"),
               metrics: Sequence[str] = METRIC_NAMES) -> DataFrame:
    """Unweighted mean and population std of each metric over the folds in which
    the slice occurs."""
    long = metrics_long(fold_metrics, [*keys, "fold"], metrics)
    return long.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.count(F.lit(1)).alias("n_folds"))


def topic_accuracies(df: DataFrame, by: Sequence[str] = ("topic",), label: str = "label",
                     pred: str = "pred", tol: int = S.TOLERANCE) -> DataFrame:
    """Correct / total per slice for the strict and flexible rules."""
    strict = to_ordinal(F.col(pred))
    y = F.col(label).cast("int")
    return df.groupBy(*by).agg(
        F.avg(F.when(strict == y, 1.0).otherwise(0.0)).alias("strict_acc"),
        F.avg(F.when(F.abs(strict - y) <= tol, 1.0).otherwise(0.0)).alias("flexible_acc"),
        F.count(F.lit(1)).alias("n"))


def label_histogram(df: DataFrame, by: Sequence[str] = ("topic",), label: str = "label") -> DataFrame:
    """Counts per (by, label): the only pass over the examples the baselines need."""
    return df.groupBy(*by, F.col(label).cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("cnt"))


def mean_baseline_topic(df: DataFrame, topic: str = "topic", label: str = "label") -> DataFrame:
    """In-sample per-topic mean predictor: mean, MSE, MAE per topic.

    Computed from the (topic, label) histogram, so the examples are scanned
    once and nothing is joined back to them."""
    hist = label_histogram(df, [topic], label)
    means = hist.groupBy(topic).agg(
        (F.sum(F.col("label") * F.col("cnt")) / F.sum("cnt")).alias("mean_prediction"),
        F.sum("cnt").alias("n"))
    joined = hist.join(means, topic)
    dev = F.col("mean_prediction") - F.col("label")
    return joined.groupBy(topic, "mean_prediction", "n").agg(
        (F.sum(F.col("cnt") * dev * dev) / F.first("n")).alias("mse"),
        (F.sum(F.col("cnt") * F.abs(dev)) / F.first("n")).alias("mae"))


def mean_baseline_overall(df: DataFrame, topic: str = "topic", label: str = "label") -> DataFrame:
    """Overall MSE, MAE and population std of residuals of the per-topic mean predictor."""
    hist = label_histogram(df, [topic], label)
    means = hist.groupBy(topic).agg(
        (F.sum(F.col("label") * F.col("cnt")) / F.sum("cnt")).alias("mean_prediction"))
    r = F.col("mean_prediction") - F.col("label")
    agg = hist.join(means, topic).agg(
        F.sum("cnt").alias("n"),
        F.sum(F.col("cnt") * r * r).alias("s2"),
        F.sum(F.col("cnt") * F.abs(r)).alias("s1"),
        F.sum(F.col("cnt") * r).alias("s"))
    n = F.col("n").cast("double")
    var = F.col("s2") / n - F.pow(F.col("s") / n, F.lit(2.0))
    return agg.select(
        F.col("n"), (F.col("s2") / n).alias("mse"), (F.col("s1") / n).alias("mae"),
        F.sqrt(F.greatest(var, F.lit(0.0))).alias("std_of_errors"))

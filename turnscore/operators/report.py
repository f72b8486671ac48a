"""Report text lines (comparison reports, fold summaries) as DataFrame rows.

Every table formatted here is small (comparisons x topics, topics x metrics);
lines carry ordering keys so a text sink writes them in report order. Numbers
are printed from their exact binary value (``functions.text.fixed``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnscore import schemas as S
from turnscore.functions.text import formatted, slug


def _matrix_lines(a: Column, b: Column, c: Column, d: Column) -> Column:
    """numpy repr of [[a, b], [c, d]]: cells right-aligned to the widest."""
    cells = [x.cast("string") for x in (a, b, c, d)]
    w = F.greatest(*[F.length(x) for x in cells])
    p = [F.lpad(x, w, " ") for x in cells]
    return F.array(F.concat(F.lit("[["), p[0], F.lit(" "), p[1], F.lit("]")),
                   F.concat(F.lit(" ["), p[2], F.lit(" "), p[3], F.lit("]]")))


def comparison_report(tests: DataFrame, errors: DataFrame) -> DataFrame:
    """Lines of each comparison's report: (comparison, file_slug, line_no, line).
    ``tests`` from ``marginal_comparisons`` / ``paired_comparisons``; ``errors`` from
    ``error_reduction``."""
    w = S.REPORT
    head = errors.select("comparison", F.posexplode(F.array(
        F.concat(F.lit(w["head"]), F.col("comparison")),
        F.repeat(F.lit("="), F.length("comparison") + w["rule_extra"]), F.lit(""))).alias("pos", "line")) \
        .withColumn("line_no", F.col("pos").cast("bigint"))
    topic = F.concat(F.lit(w["topic"]), F.col("label_en"))
    body_lines = F.when(F.col("n11").isNull(), F.array(topic, F.lit("No results of the second side."), F.lit(""))).otherwise(
        F.flatten(F.array(
            F.array(topic, F.lit(w["table"])),
            _matrix_lines(F.col("n11"), F.col("n10"), F.col("n01"), F.col("n00")),
            F.array(formatted(w["p"], F.col("p_value")), formatted(w["p_adj"], F.col("p_adj")), F.lit("")))))
    body = tests.select("comparison", "rank", F.posexplode(body_lines).alias("pos", "line")) \
        .withColumn("line_no", (F.lit(100) + F.col("rank") * 100 + F.col("pos")).cast("bigint"))
    tail = errors.select("comparison", F.posexplode(F.array(
        F.concat(F.lit(w["errors"]), F.col("comparison"), F.lit(":")),
        F.concat(F.lit(w["errors_a"]), F.col("errors_a").cast("string")),
        F.concat(F.lit(w["errors_b"]), F.col("errors_b").cast("string")),
        formatted(w["reduction"], F.col("error_reduction_pct")),
        F.concat(F.lit(w["samples"]), F.col("total_samples").cast("string")),
        F.lit(""))).alias("pos", "line")) \
        .withColumn("line_no", (F.lit(1_000_000) + F.col("pos")).cast("bigint"))
    cols = ["comparison", "line_no", "line"]
    out = head.select(*cols).unionByName(body.select(*cols)).unionByName(tail.select(*cols))
    return out.withColumn("file_slug", F.concat(slug(F.col("comparison")), F.lit("_results.txt")))


def baseline_lines(per_topic: DataFrame, overall: DataFrame) -> DataFrame:
    """The mean predictor's report (line_no, line): one line per topic in name order, then the overall values."""
    w = S.REPORT
    head = overall.select(F.posexplode(F.array(F.lit(w["baseline_head"]), F.lit(""))).alias("pos", "line")) \
        .select(F.col("pos").cast("bigint").alias("line_no"), "line")
    # one row per topic
    topics = per_topic.select(
        (F.lit(1) + F.row_number().over(Window.orderBy("topic"))).cast("bigint").alias("line_no"),
        formatted(w["baseline_topic"], "topic", "mean_prediction", "mse", "mae").alias("line"))
    tail = overall.select(F.posexplode(F.array(
        F.lit(""), F.lit(w["baseline_all"]), formatted(w["mse"], "mse"), formatted(w["mae"], "mae"),
        formatted(w["std"], "std_of_errors"))).alias("pos", "line")) \
        .select((F.lit(1_000_000) + F.col("pos")).cast("bigint").alias("line_no"), "line")
    return head.unionByName(topics).unionByName(tail)


def fold_summary_lines(summary: DataFrame) -> DataFrame:
    """The per-topic report of ``cross_fold`` (model, topic, line_no, line): a heading per topic, a
    line per metric in name order, and a blank line."""
    w = S.REPORT
    lines = F.transform(F.array_sort(F.collect_list(F.struct("metric", "mean", "std"))),
                        lambda m: formatted(w["metric"], m["metric"], m["mean"], m["std"]))
    block = summary.groupBy("model", "topic").agg(lines.alias("lines"))
    return block.select("model", "topic", F.posexplode(F.concat(
        F.array(F.concat(F.lit(w["metrics_topic"]), F.col("topic"))), "lines", F.array(F.lit("")))).alias("line_no", "line"))

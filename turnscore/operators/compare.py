"""Model comparison: 2x2 contingency tables (from marginals as in the study, or
from paired rows), exact McNemar tests, Bonferroni correction, error reduction.

All comparisons of a spec list run in one plan; every table here is small
(comparisons x topics) except the paired outcomes, which are one aggregation
of the predictions by example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnscore import schemas as S
from turnscore.functions.ordinal import to_ordinal
from turnscore.functions.stats import bonferroni, mcnemar_exact
from turnscore.functions.text import p_display


def _tests(cells: DataFrame, topic_dim: DataFrame) -> DataFrame:
    """Adds p_value (exact McNemar on n10, n01), p_adj (Bonferroni per comparison)
    and display columns; topics are shown with their English label."""
    out = cells.withColumn("p_value", mcnemar_exact(F.col("n10"), F.col("n01")))
    out = out.withColumn("p_adj", bonferroni(F.col("p_value"), "comparison"))
    return out.join(F.broadcast(topic_dim), "topic").withColumn("p_display", p_display(F.col("p_adj")))


def _spec_rows(spec) -> Column:
    """The comparison spec, a list of (name, model_a, rule_a, model_b, rule_b), as an exploded literal."""
    return F.explode(F.array(*[
        F.struct(F.lit(i).alias("cmp_rank"), F.lit(n).alias("comparison"), F.lit(ma).alias("model_a"), F.lit(ra).alias("rule_a"),
                 F.lit(mb).alias("model_b"), F.lit(rb).alias("rule_b")) for i, (n, ma, ra, mb, rb) in enumerate(spec, start=1)]))


def marginal_cells(trace: DataFrame, spec=S.COMPARISONS) -> DataFrame:
    """The study's table from marginals only: both = min(correct_a, correct_b),
    a_only = correct_a - both, b_only = correct_b - both, neither = total_a - rest.

    ``trace``: (model, topic, rule, correct, total). One aggregation gathers each
    topic's (model, rule) counts into a map; the spec is applied by explode, so
    every comparison is answered from that single small table. Driven by A's
    topics; a topic that B lacks has ``missing_in_b`` and null cells, since
    nothing is known of it (the study raises an error there)."""
    per_topic = trace.groupBy("topic").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws(":", "model", "rule"), F.struct("correct", "total")))).alias("m"))
    x = per_topic.select("topic", "m", _spec_rows(spec).alias("sp")).select("topic", "m", "sp.*")
    a = F.col("m")[F.concat_ws(":", "model_a", "rule_a")]
    b = F.col("m")[F.concat_ws(":", "model_b", "rule_b")]
    j = x.where(a.isNotNull()).select(
        "cmp_rank", "comparison", "topic", "model_a", "rule_a", "model_b", "rule_b",
        a["correct"].alias("ca"), b["correct"].alias("cb"), a["total"].alias("total"))
    both = F.when(F.col("cb").isNotNull(), F.least("ca", "cb"))
    return j.select(
        "cmp_rank", "comparison", "topic", "model_a", "rule_a", "model_b", "rule_b", "ca", "cb", "total",
        both.alias("n11"), (F.col("ca") - both).alias("n10"), (F.col("cb") - both).alias("n01"),
        (F.col("total") - F.col("ca") - F.col("cb") + both).alias("n00"),
        F.col("cb").isNull().alias("missing_in_b"))


def _shared(x: Column) -> Column:
    return F.when(~F.col("missing_in_b"), x)


def marginal_comparisons(trace: DataFrame, topic_dim: DataFrame, spec=S.COMPARISONS) -> DataFrame:
    """Per (comparison, topic): contingency cells, p, corrected p, and running error totals over
    the topics that both sides have."""
    out = _tests(marginal_cells(trace, spec), topic_dim)
    run = Window.partitionBy("comparison").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("cum_errors_a", F.sum(_shared(F.col("total") - F.col("ca"))).over(run)) \
        .withColumn("cum_errors_b", F.sum(_shared(F.col("total") - F.col("cb"))).over(run))


def error_reduction(trace: DataFrame, topic_dim: DataFrame, spec=S.COMPARISONS) -> DataFrame:
    """Per comparison, over the evaluated topics that both sides have: total errors of A and B (B's
    measured against A's totals), reduction % = (eA - eB) / eA * 100 (0 when eA = 0), total
    samples; and the number of topics that B lacks."""
    cells = marginal_cells(trace, spec) \
        .join(F.broadcast(topic_dim.select("topic")), "topic")  # fixed 9 rows

    def total(x):
        return F.coalesce(F.sum(_shared(x)), F.lit(0)).cast("bigint")
    agg = cells.groupBy("cmp_rank", "comparison").agg(
        total(F.col("total") - F.col("ca")).alias("errors_a"), total(F.col("total") - F.col("cb")).alias("errors_b"),
        total(F.col("total")).alias("total_samples"), F.sum(F.col("missing_in_b").cast("bigint")).alias("missing_topics"))
    red = F.when(F.col("errors_a") > 0,
                 (F.col("errors_a") - F.col("errors_b")).cast("double") / F.col("errors_a") * F.lit(100.0)) \
        .otherwise(F.lit(0.0))
    return agg.withColumn("error_reduction_pct", red)


def paired_cells(preds: DataFrame, spec, topic_dim: DataFrame, key: str = "example_id", label: str = "label",
                 pred: str = "pred", model: str = "model", tol: int = S.TOLERANCE) -> DataFrame:
    """Paired 2x2 tables from example-level outcomes, and ``n_unpaired``: examples that only one
    side of the comparison predicted.

    One aggregation by ``key`` gathers an example's outcomes of all models, one more
    counts equal outcomes per topic; only these few combinations meet the spec."""
    y = F.col(label).cast("int")
    strict = to_ordinal(F.col(pred))
    hit = F.struct(F.col(model).alias("model"), F.coalesce(strict == y, F.lit(False)).alias("strict"),
                   F.coalesce(F.abs(strict - y) <= tol, F.lit(False)).alias("flexible"))
    outcomes = (preds.join(F.broadcast(topic_dim.select("topic")), "topic").groupBy(key, "topic")
                .agg(F.array_sort(F.collect_set(hit)).alias("hits")).groupBy("topic", "hits").agg(F.count(F.lit(1)).alias("cnt")))
    x = outcomes.select("topic", "hits", "cnt", _spec_rows(spec).alias("sp")).select("topic", "hits", "cnt", "sp.*")

    def ok(side):
        own = F.get(F.filter("hits", lambda h: h["model"] == F.col(f"model_{side}")), F.lit(0))
        return F.when(F.col(f"rule_{side}") == "strict", own["strict"]).otherwise(own["flexible"])
    x = x.withColumn("a", ok("a")).withColumn("b", ok("b")).where("a is not null or b is not null")

    def cnt(cond):
        return F.sum(F.when(cond, F.col("cnt")).otherwise(0)).cast("bigint")
    a, b = F.col("a"), F.col("b")
    return x.groupBy("cmp_rank", "comparison", "topic", "model_a", "rule_a", "model_b", "rule_b").agg(
        cnt(a & b).alias("n11"), cnt(a & ~b).alias("n10"), cnt(~a & b).alias("n01"), cnt(~a & ~b).alias("n00"),
        cnt(a.isNull() | b.isNull()).alias("n_unpaired"))


def paired_comparisons(preds: DataFrame, spec, topic_dim: DataFrame, key: str = "example_id") -> DataFrame:
    return _tests(paired_cells(preds, spec, topic_dim, key), topic_dim)

"""Dense score histograms (0..6 per topic, zero-filled)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscore import schemas as S
from turnscore.functions.text import is_synthetic


def score_spine(topics: DataFrame) -> DataFrame:
    """Every topic row x every score 0..6 (explode, not a join)."""
    return topics.withColumn("score", F.explode(F.sequence(F.lit(S.SCORE_MIN), F.lit(S.SCORE_MAX))))


def histogram_real_synthetic(first_scores: DataFrame, topic_dim: DataFrame) -> DataFrame:
    """Per evaluated topic and score 0..6: real and synthetic subject counts.

    ``first_scores``: (topic, subject, score) from ``first_score``. Topics outside
    the 9-topic dimension and scores outside 0..6 are ignored."""
    counts = first_scores.where(F.col("score").between(S.SCORE_MIN, S.SCORE_MAX)).groupBy("topic", "score").agg(
        F.sum(F.when(is_synthetic(F.col("subject")), 0).otherwise(1)).cast("bigint").alias("real"),
        F.sum(F.when(is_synthetic(F.col("subject")), 1).otherwise(0)).cast("bigint").alias("synthetic"))
    spine = score_spine(F.broadcast(topic_dim))  # fixed 9 x 7 rows
    out = spine.join(counts, ["topic", "score"], "left")
    real = F.coalesce("real", F.lit(0)).cast("bigint")
    syn = F.coalesce("synthetic", F.lit(0)).cast("bigint")
    return out.select("rank", "topic", "label_en", "score", real.alias("real"), syn.alias("synthetic"),
                      (real + syn).alias("total"))


def histogram_topic(first_scores: DataFrame) -> DataFrame:
    """Per topic that has any valid score: counts of scores 0..6, zero-filled."""
    counts = first_scores.groupBy("topic", "score").agg(F.count(F.lit(1)).alias("cnt"))
    spine = score_spine(counts.select("topic").distinct())
    return spine.join(counts, ["topic", "score"], "left") \
        .select("topic", "score", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("count"))


def rubric_lookup(scores: DataFrame, rubric: DataFrame) -> DataFrame:
    """Attach description and criterion text (``schemas.RUBRIC``) per (topic, score).
    Spark broadcasts the user's table if it measures small."""
    return scores.join(rubric, ["topic", "score"], "left")

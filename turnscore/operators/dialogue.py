"""Dialogue assembly per (subject, topic), first valid scores, example text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnscore import schemas as S
from turnscore.functions.ordinal import nan_to_null, score_int
from turnscore.functions.text import (clean_text, dialogue_line, example_input, parse_score,
                                      parse_topic, score_output, speaker_role)
from turnscore.operators.ordered import DEFAULT_BUCKET_ROWS, bucket_of, bucket_width


def _first_valid(value: Column, seq: Column, cond: Column) -> tuple[Column, Column]:
    """(value, seq) of the earliest row meeting ``cond`` (rows failing it ignored)."""
    keep = cond & value.isNotNull()
    return F.when(keep, value), F.when(keep, seq)


def dialogues(df: DataFrame, keys: Sequence[str] = ("subject", "topic"), seq: str = "seq",
              speaker: str = "speaker", text: str = "text", score: str = "score",
              nan_text: bool = False, bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """Per group: the dialogue (``{role}: {text}`` lines joined by '\\n' in seq order),
    the first valid score of any speaker and the first valid patient score.

    Two-level: sorted partials per (group, seq bucket), then partials in bucket
    order, so a hot group is spread over its buckets. ``min_by`` partials merge
    associatively. Null text becomes '' (``nan_text=True``: the text 'nan').
    Rows with a null key belong to no group and are dropped."""
    keys = list(keys)
    df = df.dropna(subset=keys)
    txt = F.coalesce(F.col(text).cast("string"), F.lit("nan")) if nan_text else clean_text(F.col(text))
    sc = nan_to_null(F.col(score))
    line = dialogue_line(speaker_role(F.col(speaker)), txt)
    any_v, any_s = _first_valid(sc, F.col(seq), F.lit(True))
    pat_v, pat_s = _first_valid(sc, F.col(seq), F.col(speaker) == F.lit(S.PATIENT_SPEAKER))
    lvl1 = df.withColumn("_b", bucket_of(seq, bucket_width(df, seq, bucket_rows))).groupBy(*keys, "_b").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"),
                                                                      line.alias("t")))),
                                 lambda x: x["t"]), "\n").alias("_p"),
        F.min_by(F.struct(any_s.alias("s"), any_v.alias("v")), any_s).alias("_any"),
        F.min_by(F.struct(pat_s.alias("s"), pat_v.alias("v")), pat_s).alias("_pat"),
        F.count(F.lit(1)).alias("_n"))
    lvl2 = lvl1.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_b").alias("b"),
                                                                      F.col("_p").alias("p")))),
                                 lambda x: x["p"]), "\n").alias("dialogue"),
        F.min_by(F.col("_any")["v"], F.col("_any")["s"]).alias("first_score_any"),
        F.min_by(F.col("_pat")["v"], F.col("_pat")["s"]).alias("first_score_patient"),
        F.sum("_n").alias("n_turns"))
    return lvl2


def build_examples(df: DataFrame, nan_text: bool = False,
                   bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """Training examples: one per (subject, topic) that has a valid patient score.
    input = ``Topic: {topic} \\n`` + strip(``Dialogue:\\n`` + lines) + ``\\n\\n``,
    output = ``Score: {score}``."""
    d = dialogues(df, nan_text=nan_text, bucket_rows=bucket_rows)
    return d.where(F.col("first_score_patient").isNotNull()).select(
        "subject", "topic",
        example_input(F.col("topic"), F.col("dialogue")).alias("input"),
        score_output(F.col("first_score_patient")).alias("output"))


def parse_examples(examples: DataFrame, inp: str = "input", out: str = "output") -> DataFrame:
    """Adds ``label`` (int score) and ``parsed_topic`` (first line minus 'Topic:')."""
    return examples.withColumn("label", parse_score(F.col(out))) \
        .withColumn("parsed_topic", parse_topic(F.col(inp)))


def first_score(df: DataFrame, keys: Sequence[str] = ("topic", "subject"), seq: str = "seq",
                score: str = "score", speaker: str | None = None) -> DataFrame:
    """First valid score per group in seq order (``speaker`` given: only that
    speaker's rows count), as the truncated integer ``score``. Groups without a
    valid score are absent, and so are rows with a null key. A plain partial aggregation: hot groups are
    combined map-side."""
    sc = nan_to_null(F.col(score))
    d = df.dropna(subset=list(keys)).where(sc.isNotNull())
    if speaker is not None:
        d = d.where(F.col("speaker") == F.lit(speaker))
    return d.groupBy(*keys).agg(score_int(F.min_by(sc, F.col(seq))).alias("score"))

"""A corpus pipeline of five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns
of ``documents``; the last returns one row per packed piece. Stages need doc_id and text,
line_dedup also n_chars; other columns pass through whatever their names. Null and empty
texts stay through all filters (they are not toxic, hold no lines or benchmark passages, and
have an empty shingle set). Rows that repeat a doc_id are judged by their own text; rows that
repeat doc_id and text are one document in line_dedup and one stays in ngram_join. Null
doc_ids are kept and come last where the least doc_id stays. Empty tables give no rows."""

from pyspark.sql import functions as F

from turnscore.llm import toxicity as tox
from turnscore.llm.common import materialize, read_table
from turnscore.llm.decontamination import drop_leaks
from turnscore.llm.line_dedup import dedup_lines
from turnscore.llm.ngram_join import keep_one_of_each_group
from turnscore.llm.packing import pack
from turnscore.llm.queries import tokenizer_path


def toxicity(spark, docs, sf_dir):
    """Documents that the severity model rejects go."""
    return tox.drop_toxic(docs, tox.fit(docs, read_table(spark, sf_dir, "labels")))


def line_dedup(spark, docs, sf_dir):
    """Later copies of repeated line runs go from the texts; n_chars follows."""
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def ngram_join(spark, docs, sf_dir):
    """One document of each group linked by shingles of five words and a similarity of 0.8 stays."""
    return keep_one_of_each_group(docs, width=5, num=80, den=100)


def decontamination(spark, docs, sf_dir):
    """Documents that share a passage with the benchmark go."""
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark, docs, sf_dir):
    """The texts' tokens in sequences."""
    return pack(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_join", ngram_join),
          ("decontamination", decontamination), ("packing", packing)]

#: A fitted model, hashing tokenisers and packing are beyond SQL; tests/llm/test_pipeline.py checks every stage.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

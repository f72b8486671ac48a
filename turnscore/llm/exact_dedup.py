"""Exact deduplication with a split for heavy hitters.

A frequent-items sketch (the Misra-Gries family: counters with a common
decrement, as in ``approx_top_k``) names digests that may be frequent. Their
groups are then counted exactly and the verified winners are broadcast, so the
rows of a very large group are decided on the map side and never meet in one
task. All other digests are shuffled once. Only DataFrame and SQL functions run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnscore.llm.common import materialize, text_or_empty

#: Independent sketches (a digest always meets the same one), and the digests kept of each.
SKETCHES, TOP, COUNTERS = 16, 64, 1024


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after each run of ASCII white space became one
    space; the row with the smallest id stays. Null text counts as empty (all empty
    texts are one group). A null id comes after all others, so it stays only where
    the whole group has null ids (``keep_id`` is null then). Of rows that repeat
    both id and text exactly one is ``kept``. An empty table gives no rows. Other
    input columns are not read, whatever their names.

    The broadcast tables hold at most SKETCHES * TOP rows, whatever the input."""
    rows = materialize(docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(F.regexp_replace(text_or_empty(text_col), r"[\x20\x09-\x0D]+", " "), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row")), "digests")
    key = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    best = F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("row")))

    guess = (rows.select(key.alias("key")).groupBy(F.pmod("key", F.lit(SKETCHES)).alias("sketch"))
             .agg(F.expr(f"approx_top_k(key, {TOP}, {COUNTERS})").alias("top"))
             .select(F.explode("top.item").alias("key")))
    winners = (rows.withColumn("key", key).join(F.broadcast(guess), "key")
               .groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")).where("group_size > 1"))
    winners = materialize(winners.orderBy(F.desc("group_size")).limit(SKETCHES * TOP), "winners")

    heavy = rows.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    light = (rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
             .withColumn("best", best.over(group)).withColumn("group_size", F.count("*").over(group)))
    return heavy.unionByName(light).select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

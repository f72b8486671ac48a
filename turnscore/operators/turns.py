"""Turn tables: cleaning, merging consecutive same-speaker turns, segment alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnscore import schemas as S
from turnscore.functions.text import clean_text, replace_phrases, seconds_to_ms
from turnscore.operators.ordered import DEFAULT_BUCKET_ROWS, _all_equal, bucket_of, bucket_width


def clean_turns(df: DataFrame, text: str = "text", phrases=None) -> DataFrame:
    """Null text -> '', then the literal phrase replacements in order."""
    return df.withColumn(text, replace_phrases(clean_text(F.col(text)), phrases))


def merge_turns(df: DataFrame, subject: str = "subject", speaker: str = "speaker", text: str = "text",
                seq: str = "seq", order: str = "global", phrases=None,
                bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """Merge runs of consecutive turns with equal subject and speaker.

    ``order='global'``: ``seq`` orders the rows of the source (a run also breaks
    when another subject's row lies between); ``order='subject'``: ``seq`` orders
    turns within a subject only. Gaps in ``seq`` mean nothing. Text is cleaned first (null -> '',
    phrase replacement). A run keeps its first text even when empty; later
    texts are appended with one blank only when non-empty.

    Plan (one shuffle of the turns, one window pass):
      1. window per (part, seq bucket): break flags and the local run index;
      2. aggregate local runs on the same partitioning (no shuffle): sorted
         texts, first / last row keys;
      3. one row per bucket: whether its first local run continues the
         previous bucket's last run, run-id offsets (windows over buckets only);
      4. local runs get dense run ids and are grouped per run, partial texts
         joined in order.
    Output: subject, speaker, text, run_id (1.. per part), first_seq, n_turns."""
    if order not in ("global", "subject"):
        raise ValueError("order must be 'global' or 'subject'")
    d = clean_turns(df, text, phrases if phrases is not None else S.PHRASES)
    if order == "global":
        part, same = [], [subject, speaker]
    else:
        part, same = [subject], [subject, speaker]  # null subject never equal
    carry = [c for c in (subject, speaker) if c not in part]
    d = d.withColumn("_b", bucket_of(seq, bucket_width(df, seq, bucket_rows)))
    wb = Window.partitionBy(*part, "_b").orderBy(seq)
    brk = ~_all_equal([F.col(c) for c in same], [F.lag(F.col(c)).over(wb) for c in same])
    first_in_bucket = F.lag(F.col(seq)).over(wb).isNull()
    d = d.withColumn("_brk", F.when(first_in_bucket, F.lit(0)).otherwise(brk.cast("int")))
    d = d.withColumn("_cum", F.sum("_brk").over(wb.rowsBetween(Window.unboundedPreceding, 0)))

    # 2. local runs (keys constant inside a local run)
    xs = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(text).alias("t"))))
    loc = d.groupBy(*part, "_b", "_cum").agg(xs.alias("_xs"), *[F.first(c).alias(c) for c in carry])
    rest = F.filter(F.transform(F.slice("_xs", 2, F.greatest(F.size("_xs"), F.lit(1))), lambda x: x["t"]),
                    lambda t: t != "")
    keys = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(same)])
    loc = loc.select(*part, "_b", "_cum", *carry, keys.alias("_k"),
                     F.col("_xs")[0]["s"].alias("_fs"), F.element_at("_xs", -1)["s"].alias("_ls"),
                     F.col("_xs")[0]["t"].alias("_ft"), F.array_join(rest, " ").alias("_rest"),
                     F.size("_xs").alias("_n"))

    # 3. one row per bucket
    bk = loc.groupBy(*part, "_b").agg(
        F.min_by(F.struct("_k", "_fs"), F.col("_cum")).alias("_first"),
        F.max_by(F.struct("_k", "_ls"), F.col("_cum")).alias("_last"),
        F.max("_cum").alias("_mx"))
    # one row per non-empty bucket: a hot subject has at most N / bucket_rows of them
    wk = Window.partitionBy(*part).orderBy("_b")
    before = wk.rowsBetween(Window.unboundedPreceding, -1)
    prev = F.lag("_last").over(wk)
    cont = prev.isNotNull() & _all_equal([F.col("_first._k")[f"k{i}"] for i in range(len(same))],
                                         [prev["_k"][f"k{i}"] for i in range(len(same))])
    bk = bk.withColumn("_c0", cont.cast("int"))
    bk = bk.withColumn("_off", F.coalesce(F.sum(F.col("_mx") + 1 - F.col("_c0")).over(before), F.lit(0)))
    last_start = F.when((F.col("_mx") > 0) | (F.col("_c0") == 0),
                        F.col("_off") + F.col("_mx") - F.col("_c0") + 1)
    bk = bk.withColumn("_ls_id", last_start)
    bk = bk.select(*[F.col(c).alias(f"_bk_{c}") for c in [*part, "_b"]], "_c0", "_off",
                   F.last("_ls_id", ignorenulls=True).over(before).alias("_r0"))

    # 4. dense run ids, then runs. Null-safe keys: a null subject keeps its rows,
    # and no not-null filter is inferred into one branch only, so both branches
    # share the turns shuffle (ReusedExchange) instead of shuffling twice.
    run_id = F.when((F.col("_cum") == 0) & (F.col("_c0") == 1), F.col("_r0")) \
        .otherwise(F.col("_off") + F.col("_cum") - F.col("_c0") + 1).cast("bigint")
    on = F.lit(True)
    for c in [*part, "_b"]:
        on = on & loc[c].eqNullSafe(bk[f"_bk_{c}"])
    loc = loc.join(bk, on).drop(*[f"_bk_{c}" for c in [*part, "_b"]]).withColumn("run_id", run_id)
    p = F.struct(F.col("_b").alias("b"), F.col("_cum").alias("c"), F.col("_fs").alias("fs"),
                 F.col("_ft").alias("ft"), F.col("_rest").alias("rest"), F.col("_n").alias("n"))
    runs_ = loc.groupBy(*part, "run_id").agg(
        F.array_sort(F.collect_list(p)).alias("_ps"), *[F.first(c).alias(c) for c in carry])
    head = F.col("_ps")[0]
    later = F.transform(F.slice("_ps", 2, F.greatest(F.size("_ps"), F.lit(1))),
                        lambda q: F.array_join(F.filter(F.array(q["ft"], q["rest"]), lambda x: x != ""), " "))
    pieces = F.array_join(F.filter(F.concat(F.array(head["rest"]), later), lambda x: x != ""), " ")
    merged = F.concat(head["ft"], F.when(pieces != "", F.concat(F.lit(" "), pieces)).otherwise(F.lit("")))
    return runs_.select(
        F.col(subject).alias("subject"), F.col(speaker).alias("speaker"), merged.alias("text"),
        "run_id", head["fs"].alias("first_seq"),
        F.aggregate(F.col("_ps"), F.lit(0), lambda acc, q: acc + q["n"]).cast("bigint").alias("n_turns"))


def segments_ms(segments: DataFrame, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Segment table with integer millisecond bounds and the segment file key."""
    from turnscore.functions.text import segment_key
    d = segments.withColumn("start_ms", seconds_to_ms(F.col(start))) \
        .withColumn("end_ms", seconds_to_ms(F.col(end)))
    return d.withColumn("segment_key", segment_key("subject", "speaker", "start_ms", "end_ms"))


#: Bins of a level are this many times as wide as those of the level below.
LEVEL_BITS = 3


def align_segments(turns: DataFrame, segments: DataFrame, key: str = "subject",
                   t_start: str = "start_ms", t_end: str = "end_ms",
                   s_start: str = "start_ms", s_end: str = "end_ms") -> DataFrame:
    """Interval join: each turn with every segment of the same key whose time
    range overlaps it (overlap_ms > 0).

    Levels of bins, each 8 times as wide as the one below: an interval lives on the
    lowest level whose bins are at least as long as itself, where it touches two bins
    at most. It is matched there with the other side's intervals of that level and of
    the levels below, which look up their bins (again two at most) on every level
    above their own. So the joins are equi-joins on (key, level, bin), the rows of one
    interval are bounded by the number of levels (about log8 of the longest interval)
    whatever its length, and AQE splits a hot bin. A pair is emitted only in the first
    bin both share."""
    def width(level):
        return F.pow(F.lit(2.0), level * LEVEL_BITS).cast("bigint")

    def levelled(df, s, e, prefix):
        size = F.greatest(F.col(e) - F.col(s), F.lit(1))
        level = F.ceil(F.log2(size.cast("double")) / LEVEL_BITS).cast("int")
        level = F.when(width(level) < size, level + 1).otherwise(level)
        return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns], level.alias(f"{prefix}level"))

    def bins(df, prefix, s, e, level):
        w = width(level)
        return F.sequence(F.floor(F.col(f"{prefix}{s}") / w).cast("bigint"), F.floor(F.col(f"{prefix}{e}") / w).cast("bigint"))

    def at_home(df, prefix, s, e):
        return df.withColumn("_level", F.col(f"{prefix}level")).withColumn("_bin", F.explode(bins(df, prefix, s, e, F.col("_level"))))

    def look_up(df, prefix, s, e, top, above):
        first = F.col(f"{prefix}level") + above
        df = df.where(first <= top).withColumn("_level", F.explode(F.sequence(first, top)))
        return df.withColumn("_bin", F.explode(bins(df, prefix, s, e, F.col("_level"))))

    t, s = levelled(turns, t_start, t_end, "t_"), levelled(segments, s_start, s_end, "s_")
    t_top, s_top = t.select(F.coalesce(F.max("t_level"), F.lit(-1))).scalar(), s.select(F.coalesce(F.max("s_level"), F.lit(-1))).scalar()

    def joined(a, b):
        j = a.alias("a").join(b.alias("b"), (F.col(f"t_{key}") == F.col(f"s_{key}")) & (F.col("a._level") == F.col("b._level"))
                              & (F.col("a._bin") == F.col("b._bin")))
        w = width(F.col("a._level"))
        first_shared = F.greatest(F.floor(F.col(f"t_{t_start}") / w), F.floor(F.col(f"s_{s_start}") / w))
        lo = F.greatest(F.col(f"t_{t_start}"), F.col(f"s_{s_start}"))
        hi = F.least(F.col(f"t_{t_end}"), F.col(f"s_{s_end}"))
        return j.where((lo < hi) & (F.col("a._bin") == first_shared)).select(
            *[f"t_{c}" for c in turns.columns], *[f"s_{c}" for c in segments.columns], (hi - lo).alias("overlap_ms"))

    longer_segments = joined(look_up(t, "t_", t_start, t_end, s_top, 0), at_home(s, "s_", s_start, s_end))
    longer_turns = joined(at_home(t, "t_", t_start, t_end), look_up(s, "s_", s_start, s_end, t_top, 1))
    return longer_segments.unionByName(longer_turns)


__all__ = ["clean_turns", "merge_turns", "segments_ms", "align_segments"]

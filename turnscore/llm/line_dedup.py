"""Line deduplication by a suffix array over line identifiers.

The corpus is one sequence of lines per document. Suffixes (a document from some line
on) are ranked by prefix doubling: the rank over ``have + step`` lines comes from the
pair of ranks at a place and ``step`` lines later. Ranks are suffix-array indexes of
the first suffix of a bucket, over the suffixes that still repeat; a bucket of depth
d is a longest-common-prefix interval of at least d lines. A place that is not its
bucket's first is a later copy. Maximal repeated runs are the unions of overlapping
intervals of ``min_lines``: deeper intervals lie within them and would delete no
further line, so the doubling ends there. Only DataFrame and SQL functions run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnscore.llm.common import materialize, renamed, split_likely, text_or_empty

MIN_LINES = 3
MIN_CHARS = 200
#: One or two lines of more words than this, together, are a run as well.
MIN_WORDS = 50
#: Windows over ranks take at most about so many of each other's share of the corpus.
SHARES = 4096
NOT_BLANK = r"[^\x20\x09-\x0D]"
WORD = NOT_BLANK + "+"


def _words(x):
    """Words of a line; where single blanks stand between words and nowhere else, one more than blanks."""
    plain = ~(x.contains("  ") | x.startswith(" ") | x.endswith(" ") | x.contains("\t") | x.contains("\v") | x.contains("\f") | x.contains("\r"))
    return F.when(plain, F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).otherwise(F.regexp_count(x, F.lit(WORD)))


def _place():
    """Order of lines in the corpus; documents with one id are ordered by their text's hash."""
    return F.struct(F.col("id").isNull().alias("last"), "id", "th", "seq")


def _ranked(keys: DataFrame, group: str, order: str) -> DataFrame:
    """Adds ``rank``: the suffixes before a key, by ``order`` within ``group``."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return keys.withColumn("rank", F.coalesce(F.sum("n").over(w), F.lit(0)))


def _pair_ranks(keys: DataFrame, lines: int) -> DataFrame:
    """Adds ``rank`` to ``keys`` (rank1, rank2, n): the suffixes before a pair. A first rank with many second ones is
    dealt to SHARES ranges of them, whose sums give each range's start, so no window holds them all."""
    width = max(1, -(-lines // SHARES))
    keys = keys.withColumn("share", F.floor(F.col("rank2") / width))
    w = Window.partitionBy("rank1").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    starts = keys.groupBy("rank1", "share").agg(F.sum("n").alias("m")).withColumn("start", F.coalesce(F.sum("m").over(w), F.lit(0))).drop("m")
    own = Window.partitionBy("rank1", "share").orderBy("rank2").rowsBetween(Window.unboundedPreceding, -1)
    return (keys.withColumn("before", F.coalesce(F.sum("n").over(own), F.lit(0))).join(starts, ["rank1", "share"])
            .withColumn("rank", F.expr("rank1 + start + before")).drop("share", "start", "before"))


def deleted_spans(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, n_deleted, spans): per document the line ranges to delete, both ends included.
    ``docs`` has id, th (text hash) and text."""
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    full = F.filter(numbered, lambda y: y.x.rlike(NOT_BLANK))
    ids = F.transform(full, lambda y: F.struct(y.i.alias("i"), F.unhex(F.md5(y.x)).alias("line"),
                                               (F.length(y.x) >= min_chars).alias("long"), _words(y.x).alias("words")))
    lines = materialize(docs.select("id", "th", ids.alias("lines")).dropDuplicates(["id", "th"])
                        .select("id", "th", F.posexplode("lines").alias("seq", "y"))
                        .select("id", "th", "seq", "y.i", "y.line", (F.col("y.long") | (F.col("y.words") > min_words)).alias("long"), "y.words"),
                        "lines")

    # depth 1: rank of each repeated line, by buckets of the line's first two bytes
    keys = materialize(lines.groupBy("line").agg(F.count("*").alias("n"), F.min(_place()).alias("first")).where("n > 1")
                       .withColumn("bucket", F.hex(F.substring("line", 1, 2))), "line-keys")
    heads = _ranked(keys.groupBy("bucket").agg(F.sum("n").alias("n"), F.lit(0).alias("one")), "one", "bucket")  # at most 65,536 rows
    keys = (_ranked(keys, "bucket", "line").join(heads.select("bucket", F.col("rank").alias("head")), "bucket")
            .select("line", "first", (F.col("rank") + F.col("head")).alias("rank")))
    active = materialize(lines.join(keys, "line").select(
        "id", "th", "seq", "i", "long", "words", "rank", (_place() > F.col("first")).alias("copy")), "suffixes-1")
    n_lines = lines.agg(F.count("*")).first()[0]
    deep, have, pairs_gone = active, 1, None
    while have < min_lines:
        step = min(have, min_lines - have)
        ahead = Window.partitionBy("id", "th").orderBy("seq").rangeBetween(step, step)
        both = F.col("words") + F.first("words").over(ahead) if have == 1 else F.col("words")  # of the first two lines
        pairs = (deep.select("id", "th", "seq", both.alias("words"), "rank", F.first("rank").over(ahead).alias("rank2"))
                 .where("rank2 is not null"))
        keys = pairs.groupBy("rank", "rank2").agg(F.count("*").alias("n"), F.min(_place()).alias("first")).where("n > 1")
        keys = materialize(keys.withColumnRenamed("rank", "rank1"), "pair-keys")
        # ranks of the last depth would order nothing any more
        keys = _pair_ranks(keys, n_lines) if have + step < min_lines else keys.withColumn("rank", F.col("rank1"))
        deep = pairs.withColumnRenamed("rank", "rank1").join(keys.drop("n"), ["rank1", "rank2"])
        have += step
        deep = materialize(deep.select("id", "th", "seq", "words", "rank", (_place() > F.col("first")).alias("copy")), f"suffixes-{have}")
        if have == 2:
            pairs_gone = deep.where("copy and words > " + str(min_words))

    # a line goes if an interval's later copy covers it, or if it is long and itself a later copy; likewise two lines
    alone = active.select("id", "th", "seq", "i", (F.col("copy") & F.col("long")).alias("gone"), F.lit(0).alias("begins"))
    def begin(rows, lines):
        return rows.select("id", "th", "seq", F.lit(None).cast("int").alias("i"), F.lit(False).alias("gone"), F.lit(lines).alias("begins"))
    marks = alone.unionByName(begin(deep.where("copy"), min_lines))
    if pairs_gone is not None and min_lines > 2:
        marks = marks.unionByName(begin(pairs_gone, 2))
    own = Window.partitionBy("id", "th").orderBy("seq")
    covered = (F.max(F.col("begins") == min_lines).over(own.rangeBetween(1 - min_lines, 0))
               | F.max(F.col("begins") == 2).over(own.rangeBetween(-1, 0)))
    gone = marks.withColumn("covered", covered).where("i is not null and (gone or covered)")
    return (gone.withColumn("island", F.col("seq") - F.row_number().over(own))
            .groupBy("id", "th", "island").agg(F.min("i").alias("start"), F.max("i").alias("end"), F.count("*").alias("n"))
            .groupBy("id", "th").agg(F.sum("n").alias("n_deleted"),
                                     F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES,
                min_chars: int = MIN_CHARS, report: bool = False, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from the text.

    Lines are separated by newlines; blank ones are not part of the sequence and go only
    inside a deleted run. A run repeats if it has ``min_lines`` lines, or is one line of
    ``min_chars`` characters, or one or two lines of more than ``min_words`` words together, and
    the same lines stand elsewhere, also in the same document. (Two lines are looked at where
    ``min_lines`` is 2 or more.) The first copy by (id, text hash, line) stays; null ids come last. Rows
    that repeat both id and text are one document and are changed alike. Null text
    stays null, a text may become empty, and an empty table gives no rows. All columns
    are kept, whatever their names. With ``report``, instead id, n_lines, n_deleted (not
    blank), n_spans and kept_sha256 are returned; null text counts as empty there."""
    columns, id_name = docs.columns, id_col
    docs, (id_col, text_col) = renamed(docs, id_col, text_col)
    text = text_or_empty(text_col)
    own = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("th", F.xxhash64("text"))
    spans = materialize(deleted_spans(own, min_lines, min_chars, min_words), "spans").select(
        F.col("id").alias("_ld_id"), F.col("th").alias("_ld_th"), F.col("n_deleted").alias("_ld_n"), F.col("spans").alias("_ld_spans"))
    some, rest = split_likely(docs, F.xxhash64(text), spans, "_ld_th")
    both = (some.join(spans, (F.xxhash64(text) == F.col("_ld_th")) & F.col(id_col).eqNullSafe(F.col("_ld_id")), "left")
            .unionByName(rest, allowMissingColumns=True))
    lines = F.split(text, "\n", -1)
    begin = F.concat(F.array(F.lit(0)), F.transform("_ld_spans", lambda s: s.end + 1))
    stop = F.concat(F.transform("_ld_spans", lambda s: s.start), F.array(F.size(lines)))
    kept = F.array_join(F.flatten(F.zip_with(begin, stop, lambda a, b: F.slice(lines, a + 1, b - a))), "\n")
    kept = F.when(F.col("_ld_spans").isNull(), F.col(text_col)).otherwise(kept)
    if not report:
        return both.select(*[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]).toDF(*columns)
    return both.select(
        F.col(id_col).alias(id_name), F.size(lines).cast("long").alias("n_lines"), F.coalesce("_ld_n", F.lit(0)).cast("long").alias("n_deleted"),
        F.coalesce(F.size("_ld_spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.sha2(F.coalesce(kept, F.lit("")), 256).alias("kept_sha256"))

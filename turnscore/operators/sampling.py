"""Reproducible shuffles, exact global ranks, k-fold assignment, nested prefixes.

The shuffle order is the md5 of ``key:seed`` (engine independent). An exact rank
over that order is computed without a one-partition window: rows are bucketed
by the leading hex digits of the hash (buckets are contiguous in rank order),
bucket sizes give offsets (a table of at most 16**digits rows per partition
value, broadcast), and ``row_number`` runs inside each bucket only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnscore import schemas as S

DEFAULT_HEX_DIGITS = 4  # 65,536 buckets: ~1.5e7 rows per bucket at 1e12 rows


def shuffle_key(keys: Sequence[str | Column], seed) -> Column:
    """md5 hex of ``k1:k2:...:seed``; the seed may be a literal or a column."""
    parts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    seed_col = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", *parts, seed_col))


def exact_rank(df: DataFrame, keys: Sequence[str], seed=S.SEED, partition_by: Sequence[str] = (),
               rank_col: str = "rank", total_col: str = "n_total",
               hex_digits: int = DEFAULT_HEX_DIGITS) -> DataFrame:
    """1-based dense rank of each row in md5 order within ``partition_by``, and the
    partition size. ``partition_by`` must be low-cardinality (e.g. an outer fold)."""
    part = list(partition_by)
    h = df.withColumn("_h", shuffle_key(keys, seed)) \
        .withColumn("_b", F.substring("_h", 1, hex_digits))
    counts = h.groupBy(*part, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    # windows over the bucket counts only: at most 16**hex_digits rows per partition value
    running = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    offsets = counts.select(
        *part, "_b",
        (F.sum("_cnt").over(running) - F.col("_cnt")).alias("_off"),
        F.sum("_cnt").over(Window.partitionBy(*part)).alias(total_col))
    # at most 16**hex_digits rows per partition value: a hint only where that is all there is
    ranked = h.join(offsets if part else F.broadcast(offsets), [*part, "_b"])
    in_bucket = Window.partitionBy(*part, "_b").orderBy("_h", *keys)
    return ranked.withColumn(rank_col, (F.col("_off") + F.row_number().over(in_bucket)).cast("bigint")) \
        .drop("_h", "_b", "_off")


def fold_of_rank(rank: Column, n: Column, k: int) -> Column:
    """0-based fold of a 1-based rank when n rows are cut into k contiguous folds,
    the first n % k folds one row larger (scikit-learn KFold sizes)."""
    r0 = rank - F.lit(1)
    q = F.floor(n / F.lit(k)).cast("bigint")
    m = n - q * F.lit(k)
    big = m * (q + F.lit(1))
    return F.when(r0 < big, F.floor(r0 / (q + F.lit(1)))) \
        .otherwise(m + F.floor((r0 - big) / q)).cast("int")


def kfold(df: DataFrame, keys: Sequence[str], k: int = S.N_FOLDS, seed=S.SEED,
          fold_col: str = "fold", hex_digits: int = DEFAULT_HEX_DIGITS) -> DataFrame:
    """Shuffled k-fold assignment: adds ``fold`` (0..k-1), ``rank`` and ``n_total``."""
    ranked = exact_rank(df, keys, seed, hex_digits=hex_digits)
    return ranked.withColumn(fold_col, fold_of_rank(F.col("rank"), F.col("n_total"), k))


def prefix_sizes(n_total: Column, fractions: Sequence[float]) -> Column:
    """Array of ``int(N * frac)`` for each fraction (double arithmetic, truncation)."""
    return F.array(*[F.floor(n_total.cast("double") * F.lit(float(f))).cast("bigint") for f in fractions])


def pool_ranks(folded: DataFrame, keys: Sequence[str], k: int = S.N_FOLDS, seed=S.SEED, fold_col: str = "fold",
               hex_digits: int = DEFAULT_HEX_DIGITS) -> DataFrame:
    """Adds ``pools``: an array of (outer_fold, pool_rank) with the row's 1-based rank in the shuffled training
    pool (the rows not in that fold) of every other fold.

    All pools share one seeded order (md5 of ``key:seed:pool``); a row's rank in
    pool f is its rank in that order minus the fold-f rows ahead of it. So the
    rows are ranked once - bucket counts per fold give offsets, one window per
    md5 bucket gives positions and running fold counts."""
    h = folded.withColumn("_h", shuffle_key(keys, f"{seed}:pool")) \
        .withColumn("_b", F.substring("_h", 1, hex_digits))
    in_fold = [F.when(F.col(fold_col) == f, 1).otherwise(0) for f in range(k)]
    counts = h.groupBy("_b").agg(F.count(F.lit(1)).alias("_cnt"),
                                 *[F.sum(c).alias(f"_c{f}") for f, c in enumerate(in_fold)])
    # window over the bucket counts only: at most 16**hex_digits rows
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_b", *[F.coalesce(F.sum(f"_c{f}").over(before), F.lit(0)).alias(f"_o{f}")
                                    for f in range(k)],
                            F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_o"))
    # bounded: at most 16**hex_digits rows
    ranked = h.join(F.broadcast(offsets), "_b")
    w = Window.partitionBy("_b").orderBy("_h", *keys)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("_r", F.col("_o") + F.row_number().over(w))
    for f, c in enumerate(in_fold):
        ranked = ranked.withColumn(f"_a{f}", F.col(f"_o{f}") + F.sum(c).over(upto))
    pools = F.filter(F.array(*[F.struct(F.lit(f).alias("outer_fold"),
                                        (F.col("_r") - F.col(f"_a{f}")).alias("pool_rank"))
                               for f in range(k)]),
                     lambda p: p["outer_fold"] != F.col(fold_col))
    return ranked.withColumn("pools", pools).drop("_h", "_b", "_r", "_o", *[f"_o{f}" for f in range(k)], *[f"_a{f}" for f in range(k)])


def _step(rank: Column, fractions: Sequence[float]) -> Column:
    """Index of the smallest fraction whose prefix holds the rank; null when none does."""
    below = F.size(F.filter(prefix_sizes(F.col("n_total"), fractions), lambda s: s < rank))
    return F.when(below < len(fractions), below).cast("int")


def nested_prefix(folded: DataFrame, keys: Sequence[str], k: int = S.N_FOLDS, seed=S.SEED,
                  fractions: Sequence[float] = S.FRACTIONS, fold_col: str = "fold",
                  hex_digits: int = DEFAULT_HEX_DIGITS) -> DataFrame:
    """For every outer fold f, the training pool (rows not in f) in a shuffled
    order, ``pool_rank`` (1-based) and ``frac_idx`` = index of the smallest fraction
    whose prefix ``int(N*frac)`` (N = whole data set) contains the row (null when
    none does). Prefixes are nested by construction. Each row is expanded to its
    k-1 pools only after the ranking of ``pool_ranks``.

    Input must carry ``fold`` and ``n_total`` (from ``kfold``)."""
    out = pool_ranks(folded, keys, k, seed, fold_col, hex_digits).withColumn("_p", F.explode("pools")) \
        .withColumn("outer_fold", F.col("_p.outer_fold")) \
        .withColumn("pool_rank", F.col("_p.pool_rank").cast("bigint")).drop("_p", "pools")
    return out.withColumn("frac_idx", _step(F.col("pool_rank"), fractions))


def nested_steps(folded: DataFrame, keys: Sequence[str], k: int = S.N_FOLDS, seed=S.SEED,
                 fractions: Sequence[float] = S.FRACTIONS) -> DataFrame:
    """One row per input row: ``steps``, an array with the row's ``frac_idx`` of ``nested_prefix`` for each
    outer fold 0..k-1; null for the row's own fold, and where no prefix holds the row."""
    ranked = pool_ranks(folded, keys, k, seed)
    rank = [F.get(F.transform(F.filter("pools", _is_fold(f)), lambda p: p["pool_rank"]), F.lit(0)) for f in range(k)]
    return ranked.withColumn("steps", F.array(*[F.when(r.isNotNull(), _step(r, fractions)) for r in rank])).drop("pools")


def _is_fold(f: int):
    return lambda p: p["outer_fold"] == f

"""Order-dependent operators that stay parallel when one group is huge.

Row order is an explicit integer ``seq`` (unique within a partition key). Windows
are partitioned by a *bucket* of ``seq`` of about ``bucket_rows`` rows, so no
task holds many more rows of one key, however hot the key. What crosses a bucket border (the previous row, running counts) is
carried by a per-bucket summary of one row per non-empty bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_BUCKET_ROWS = 1 << 16


#: Shares of the rows whose ``seq`` are found by a sketch: 256 equal ones, and finer ones at both ends for outliers.
_ENDS = [1e-5, 1e-4, 1e-3]
_SHARES = sorted({*(i / 256 for i in range(257)), *_ENDS, *(1 - e for e in _ENDS)})


@dataclass(frozen=True)
class Borders:
    """``at``: the values of ``seq`` at _SHARES of its ``n`` rows (none for an empty table), and the rows of a bucket."""
    at: tuple[float, ...]
    n: int
    rows: int


def bucket_of(seq: str, width) -> Column:
    """Number of the bucket of ``seq``, never falling with it: ``width`` is how much of ``seq`` a bucket spans, or
    the result of ``bucket_width``."""
    if isinstance(width, int):
        return F.floor(F.col(seq) / F.lit(width)).cast("bigint")
    if not width.at or width.n <= width.rows:
        # always 0, but no constant, which would take the key out of joins by bucket
        return F.pmod(F.coalesce(F.col(seq).cast("bigint"), F.lit(0)), F.lit(1)).cast("bigint")
    value, last = F.col(seq).cast("double"), len(_SHARES) - 1
    shares, borders = F.array(*[F.lit(x) for x in _SHARES]), F.array(*[F.lit(x) for x in width.at])

    def halve(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = F.get(borders, mid) <= value
        return F.struct(F.when(below, mid).otherwise(acc["lo"]).alias("lo"), F.when(below, acc["hi"]).otherwise(mid).alias("hi"))

    def number(acc):
        a, b = F.get(borders, acc["lo"]), F.get(borders, acc["hi"])
        p, q = F.get(shares, acc["lo"]), F.get(shares, acc["hi"])
        inside = F.when(b > a, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - a) / (b - a)))).otherwise(F.lit(0.0))
        rank = F.least(q, p + inside * (q - p)) * float(width.n)  # estimated rows before
        return F.floor(rank / float(width.rows)).cast("bigint")

    steps = F.sequence(F.lit(1), F.lit(last.bit_length()))
    return F.coalesce(F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(last).alias("hi")), halve, number), F.lit(0).cast("bigint"))


def bucket_width(df: DataFrame, seq: str, bucket_rows: int) -> Borders:
    """Borders that follow the counts of ``seq``, so that a bucket has about ``bucket_rows`` rows however unevenly
    ``seq`` is spread, and one far outlier does not put all others into one bucket. Reads the ``seq``
    column alone, for a quantile sketch of fixed size, between whose borders rows count as evenly spread."""
    shares = F.array(*[F.lit(x) for x in _SHARES])
    r = df.agg(F.percentile_approx(F.col(seq).cast("double"), shares, 100_000).alias("at"), F.count(seq).alias("n")).first()
    return Borders(tuple(r.at or ()), r.n, bucket_rows)


def _all_equal(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """True only when every pair is equal and non-null (null never equals)."""
    cond = F.lit(True)
    for x, y in zip(a, b):
        cond = cond & F.coalesce(x == y, F.lit(False))
    return cond

"""Statistical column expressions (no Python UDF; higher-order SQL functions)."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Terms summed by one inner loop; the loops' arrays have a fixed size, or one entry per such loop.
CHUNK = 4096


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _stirling_rest(m: Column) -> Column:
    """ln(m!) - ((m + 1/2) ln m - m + ln(2 pi) / 2) for m >= 1: exact values up to 15, then the series."""
    small = [math.lgamma(i + 1) - ((i + 0.5) * math.log(i) - i + 0.5 * math.log(2 * math.pi)) for i in range(1, 16)]
    x = m.cast("double")
    y = F.lit(1.0) / (x * x)
    series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y * (1 / 1188))))) / x
    return F.when(m <= 15, F.element_at(F.array(*map(F.lit, small)), F.greatest(F.lit(1), F.least(F.lit(15), m)).cast("int"))
                  ).otherwise(series)


def _deviance(d: Column) -> Column:
    """(1 - d) ln(1 - d) + (1 + d) ln(1 + d) for 0 <= d < 1, without cancellation near 0."""
    s = d * d
    near = F.lit(0.0)
    for j in range(12, 0, -1):
        near = F.lit(1.0 / (j * (2 * j - 1))) + s * near
    return F.when(d < 0.1, s * near).otherwise((1 - d) * F.log1p(-d) + (1 + d) * F.log1p(d))


def mcnemar_exact(b, c) -> Column:
    """Exact (binomial) McNemar p-value for discordant counts b, c; null where one is null.

    p = min(1, 2 P[X <= k]), k = min(b, c), X ~ Binomial(n = b + c, 1/2). By symmetry it is 1 where
    b and c differ by one at most. ln P[X = k] is in deviance form, whose parts do not cancel,
    and the tail below k is the sum of the ratios i / (n - i + 1) downward from k until terms
    no longer change a double: after j steps a term is below exp(-j^2 / n), so 40 sqrt(n)
    steps hold all that is not 0, and summing ends sooner once terms are below 1e-18 of the
    sum. Work per row is O(min(k, sqrt(n))); no array holds more than CHUNK entries or one
    for each chunk."""
    b, c = _c(b).cast("bigint"), _c(c).cast("bigint")
    n, k = b + c, F.least(b, c)
    d = F.abs(b - c).cast("double") / n
    log_pmf = F.when(k == 0, -n * F.lit(math.log(2.0))).otherwise(
        _stirling_rest(n) - _stirling_rest(k) - _stirling_rest(n - k) - n.cast("double") / 2 * _deviance(d)
        - F.lit(0.5) * (F.lit(math.log(2 * math.pi)) + F.log(k.cast("double")) + F.log1p(-k.cast("double") / n)))
    steps = F.least(k, (F.ceil(F.lit(40.0) * F.sqrt(n.cast("double"))) + F.lit(100)).cast("bigint"))
    inner = F.sequence(F.lit(1).cast("bigint"), F.lit(CHUNK).cast("bigint"))

    def chunk(acc: Column, i: Column) -> Column:
        def term(a: Column, j: Column) -> Column:
            at = i * CHUNK + j
            r = a["r"] * F.greatest(k - at + 1, F.lit(0)).cast("double") / (n - k + at).cast("double")
            return F.struct(r.alias("r"), (a["s"] + r).alias("s"))
        return F.when(acc["r"] <= acc["s"] * 1e-18, acc).otherwise(F.aggregate(inner, acc, term))

    tail = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.floor(steps / CHUNK).cast("bigint")),
                       F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("s")), chunk, lambda acc: acc["s"])
    return F.when(b.isNull() | c.isNull(), F.lit(None).cast("double")).when(F.abs(b - c) <= 1, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), F.lit(2.0) * F.exp(log_pmf + F.log(tail))))


def bonferroni(p, partition_by) -> Column:
    """min(1, p * m) with m = number of tests (p not null) in the partition; null p stays null."""
    cols = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    m = F.count(_c(p)).over(Window.partitionBy(*cols))
    return F.when(_c(p).isNotNull(), F.least(F.lit(1.0), _c(p) * m))

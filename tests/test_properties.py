"""Property checks with generated inputs."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnscore.functions.stats import mcnemar_exact
from turnscore.operators import turns as TU


def _p(b, c):
    n, k = b + c, min(b, c)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2 ** n)


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 400)), min_size=30, max_size=30))
def test_mcnemar_bounds_symmetry_and_exactness(spark, pairs):
    rows = pairs + [(c, b) for b, c in pairs]
    df = spark.createDataFrame(rows, "b LONG, c LONG")
    got = [r.p for r in df.select(mcnemar_exact(F.col("b"), F.col("c")).alias("p")).collect()]
    half = len(pairs)
    for i, (b, c) in enumerate(pairs):
        assert 0.0 <= got[i] <= 1.0
        assert got[i] == got[half + i]
        assert math.isclose(got[i], _p(b, c), rel_tol=1e-9, abs_tol=1e-300)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["A", "B"]), st.sampled_from(["S0", "S1"]),
                          st.sampled_from(["x", "y", "hallo", "ja nein"])), min_size=1, max_size=60),
       st.sampled_from([1, 3, 64]))
def test_merge_idempotent_without_empties(spark, rows, bucket_rows):
    df = spark.createDataFrame([(s, p, t, i) for i, (s, p, t) in enumerate(rows)],
                               "subject STRING, speaker STRING, text STRING, seq LONG")
    once = TU.merge_turns(df, bucket_rows=bucket_rows)
    again = TU.merge_turns(once.select("subject", "speaker", "text", (F.col("run_id") - 1).alias("seq")),
                           bucket_rows=bucket_rows)
    a = [(r.subject, r.speaker, r.text) for r in once.orderBy("run_id").collect()]
    b = [(r.subject, r.speaker, r.text) for r in again.orderBy("run_id").collect()]
    assert a == b
    assert sum(r.n_turns for r in once.collect()) == len(rows)

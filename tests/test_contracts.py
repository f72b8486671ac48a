"""Hand-written contract cases (FIXTURES.md section 4) and properties."""

import math

import pytest
from pyspark.sql import functions as F

from turnscore import schemas as S
from turnscore.functions.ordinal import to_ordinal, tolerant
from turnscore.functions.stats import bonferroni, mcnemar_exact
from turnscore.functions.text import fraction_label, p_display, side_name, slug, subject_key, subject_key_parts
from turnscore.operators import compare as CP
from turnscore.operators import confusion as CF
from turnscore.operators import metrics as M
from turnscore.operators import sampling as SA
from turnscore.operators import similarity as SI


def binom_p(b, c):
    n, k = b + c, min(b, c)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2 ** n)


def test_ordinal_and_tolerant(spark):
    vals = [-0.5, 0.5, 1.5, 2.5, 3.4999, 6.5, 7.2, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in vals], "p DOUBLE")
    got = [r.o for r in df.select(to_ordinal(F.col("p")).alias("o")).collect()]
    assert got == [0, 0, 2, 2, 3, 6, 6, None, None]
    t = spark.createDataFrame([(3, 4), (3, 5)], "label INT, strict INT")
    assert [r.f for r in t.select(tolerant(F.col("strict"), F.col("label")).alias("f")).collect()] == [3, 5]


@pytest.mark.parametrize("b,c", [(0, 0), (0, 5), (3, 10), (5, 5), (40, 61), (250, 300), (0, 2000)])
def test_mcnemar_exact(spark, b, c):
    df = spark.createDataFrame([(b, c)], "b LONG, c LONG")
    p = df.select(mcnemar_exact(F.col("b"), F.col("c")).alias("p")).first().p
    assert p == pytest.approx(binom_p(b, c), rel=1e-9, abs=1e-300)


def test_mcnemar_fixture_values(spark):
    df = spark.createDataFrame([(0, 0), (0, 5), (3, 10), (5, 5)], "b LONG, c LONG")
    got = [r.p for r in df.select(mcnemar_exact(F.col("b"), F.col("c")).alias("p")).collect()]
    assert got == pytest.approx([1.0, 0.0625, 0.09228515625, 1.0], rel=1e-12)


def exact_p(b, c):
    """The p-value with 50 digits: log-factorials by their asymptotic series, and the tail ratio by ratio."""
    from decimal import Decimal as D, getcontext
    getcontext().prec = 50
    pi = D("3.14159265358979323846264338327950288419716939937510")
    bernoulli = [D(1) / 6, D(-1) / 30, D(1) / 42, D(-1) / 30, D(5) / 66, D(-691) / 2730, D(7) / 6]

    def log_factorial(m):
        m = D(m)
        return (m + D("0.5")) * m.ln() - m + (2 * pi).ln() / 2 + sum(
            x / (2 * (i + 1) * (2 * i + 1) * m ** (2 * i + 1)) for i, x in enumerate(bernoulli))

    n, k = b + c, min(b, c)
    term = (log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * D(2).ln()).exp()
    total, i = D(0), k
    while i >= 0 and term > total * D("1e-25"):
        total += term
        term = term * i / (n - i + 1)
        i -= 1
    return float(min(D(1), 2 * total))


@pytest.mark.parametrize("b,c", [(150_000, 151_000), (99_000, 101_000), (1_000_000, 1_003_000), (400_000, 900_000),
                                 (2_000_000_000, 2_000_100_000), (4_999_999_000, 5_000_000_000), (70, 1_000_000)])
def test_mcnemar_large_counts_are_exact(spark, b, c):
    df = spark.createDataFrame([(b, c), (c, b)], "b LONG, c LONG")
    want = exact_p(b, c)
    for r in df.select(mcnemar_exact(F.col("b"), F.col("c")).alias("p")).collect():
        assert r.p == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_mcnemar_equal_and_null_counts(spark):
    df = spark.createDataFrame([(n, n) for n in (0, 1, 5_000, 5_000_000_000, 5_000_000_000_000)] + [(7, 8), (None, 3), (3, None)],
                               "b LONG, c LONG")
    assert [r.p for r in df.select(mcnemar_exact(F.col("b"), F.col("c")).alias("p")).collect()] == [1.0] * 6 + [None, None]


def test_topic_that_the_second_side_lacks(spark):
    """Equal models on the only topic they share: no reduction, one test, and nothing invented for the other topic."""
    tr = spark.createDataFrame([("base", "Schlaf", "strict", 10, 20), ("base", "Suizid", "strict", 50, 75), ("tuned", "Schlaf", "strict", 10, 20)],
                               "model STRING, topic STRING, rule STRING, correct LONG, total LONG")
    spec = [("X vs. Y", "base", "strict", "tuned", "strict")]
    er = CP.error_reduction(tr, S.topic_dim(spark), spec).first()
    assert (er.errors_a, er.errors_b, er.total_samples, er.missing_topics, er.error_reduction_pct) == (10, 10, 20, 1, 0.0)
    rows = {r.topic: r for r in CP.marginal_comparisons(tr, S.topic_dim(spark), spec).collect()}
    lost, kept = rows["Suizid"], rows["Schlaf"]
    assert lost.missing_in_b and {lost[c] for c in ("cb", "n11", "n10", "n01", "n00", "p_value", "p_adj", "p_display")} == {None}
    assert (kept.p_value, kept.p_adj, kept.cum_errors_a, lost.cum_errors_a, lost.cum_errors_b) == (1.0, 1.0, 10, 10, 10)


def test_bonferroni(spark):
    df = spark.createDataFrame([("c", 0.2)] + [("c", 0.5)] * 7 + [("c", 0.001)], "comparison STRING, p DOUBLE")
    got = sorted(r.q for r in df.select(bonferroni(F.col("p"), "comparison").alias("q")).collect())
    assert got[0] == pytest.approx(0.009) and got[-1] == 1.0


def test_kfold_sizes_and_partition(spark):
    df = spark.range(13).withColumnRenamed("id", "example_id")
    folds = SA.kfold(df, ["example_id"], k=5, hex_digits=1).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in folds] == [3, 3, 3, 2, 2]


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_exact_rank_dense_and_partition_invariant(spark, parts):
    df = spark.range(500).withColumnRenamed("id", "k").repartition(parts)
    r = SA.exact_rank(df, ["k"], hex_digits=2).collect()
    assert sorted(x["rank"] for x in r) == list(range(1, 501))
    ref = {x.k: x["rank"] for x in SA.exact_rank(spark.range(500).withColumnRenamed("id", "k"), ["k"],
                                                  hex_digits=2).collect()}
    assert {x.k: x["rank"] for x in r} == ref


def test_nested_prefixes(spark):
    df = spark.range(200).withColumnRenamed("id", "example_id")
    pools = SA.nested_prefix(SA.kfold(df, ["example_id"]), ["example_id"]).collect()
    by_fold = {}
    for r in pools:
        by_fold.setdefault(r.outer_fold, []).append(r)
    for f, rows in by_fold.items():
        assert all(r.fold != f for r in rows)
        for j, frac in enumerate(S.FRACTIONS):
            size = sum(1 for r in rows if r.frac_idx is not None and r.frac_idx <= j)
            assert size == min(int(200 * frac), len(rows))


def test_contingency_and_error_reduction(spark):
    tr = spark.createDataFrame([("base", "Schlaf", "strict", 10, 20), ("tuned", "Schlaf", "strict", 14, 20)],
                               "model STRING, topic STRING, rule STRING, correct LONG, total LONG")
    spec = [("X vs. Y", "base", "strict", "tuned", "strict")]
    cells = CP.marginal_cells(tr, spec).first()
    assert (cells.n11, cells.n10, cells.n01, cells.n00) == (10, 0, 4, 6) and not cells.missing_in_b
    only_a = tr.where("model = 'base'").union(
        spark.createDataFrame([("tuned", "Suizid", "strict", 1, 2)], tr.schema))
    assert CP.marginal_cells(only_a, spec).first().missing_in_b
    er = CP.error_reduction(tr, S.topic_dim(spark), spec).first()
    assert er.errors_a == 10 and er.errors_b == 6 and er.error_reduction_pct == pytest.approx(40.0)
    z = spark.createDataFrame([("base", "Schlaf", "strict", 20, 20), ("tuned", "Schlaf", "strict", 20, 20)],
                              "model STRING, topic STRING, rule STRING, correct LONG, total LONG")
    assert CP.error_reduction(z, S.topic_dim(spark), spec).first().error_reduction_pct == 0.0


def test_confusion_properties_and_document_roundtrip(spark):
    rows = [(i, "Schlaf" if i % 2 else "Suizid", i % 7, (i * 13 % 90) / 10.0 - 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "example_id LONG, topic STRING, label INT, pred DOUBLE") \
        .withColumn("model", F.lit("m"))
    dense = CF.confusion(df, S.topic_dim(spark))
    tot = {(r.topic, r.rule): r.total for r in CF.trace(dense).collect()}
    assert tot[("Schlaf", "strict")] == 150 and tot[("Suizid", "flexible")] == 150
    tr = {(r.topic, r.rule): r.correct for r in CF.trace(dense).collect()}
    assert tr[("Schlaf", "strict")] <= tr[("Schlaf", "flexible")]
    acc = M.evaluate(df.where(F.col("topic") == "Schlaf")).first().strict_acc
    assert acc == pytest.approx(tr[("Schlaf", "strict")] / 150)
    doc = CF.confusion_document(dense)
    back = CF.explode_document(doc, "doc", by=["model"])
    a = sorted(tuple(r) for r in dense.select("topic", "rule", "true_score", "pred_score", "n").collect())
    b = sorted(tuple(r) for r in back.select("topic", "rule", "true_score", "pred_score", "n").collect())
    assert a == b


def test_cosine_zero_vector_and_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(40, 8)).tolist()
    vecs[3] = [0.0] * 8
    rows = [(i, v, i % 3, i % 2 == 1) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "id LONG, emb ARRAY<DOUBLE>, score INT, synthetic BOOLEAN")
    got = SI.cosine_mean(df).first()
    a = np.array(vecs)
    norms = np.linalg.norm(a, axis=1)
    u = np.divide(a, norms[:, None], out=np.zeros_like(a), where=norms[:, None] > 0)
    real, syn = u[0::2], u[1::2]
    assert got.mean_cosine == pytest.approx(float((real @ syn.T).mean()), abs=1e-12)
    ext = SI.cosine_extremes(df, block_rows=4).first()
    assert ext.max_cosine == pytest.approx(float((real @ syn.T).max()))
    assert ext.min_cosine == pytest.approx(float((real @ syn.T).min()))
    assert ext.n_pairs == 400 and 0 < ext.pairs_examined <= 400
    sims = real @ syn.T
    near = sorted((r.real_id, r.synthetic_id) for r in SI.near_pairs(df, 0.3, block_rows=3).collect())
    exp = sorted((2 * i, 2 * j + 1) for i, j in zip(*np.nonzero(sims >= 0.3)))
    assert near == exp and len(exp) > 0


def test_text_helpers(spark):
    df = spark.createDataFrame([("Video/MC_1234/MC_1234_MADRS.mp4", "A vs. B.c", 0.05, 0.00001)],
                               "p STRING, name STRING, frac DOUBLE, q DOUBLE")
    r = df.select(subject_key(F.col("p")).alias("k"), subject_key_parts(F.lit("f_MC_1234_MADRS.wav")).alias("k2"),
                  slug(F.col("name")).alias("s"), side_name(F.col("name"), 1).alias("a"),
                  side_name(F.col("name"), 2).alias("b"), fraction_label(F.col("frac")).alias("fl"),
                  p_display(F.col("q")).alias("pd"), p_display(F.lit(0.5)).alias("pd2")).first()
    assert (r.k, r.k2, r.s, r.a, r.b, r.fl, r.pd, r.pd2) == (
        "MC_1234", "MC_1234_MADRS.wav", "a_vs_bc", "A", "B.c", "5%", "P < 0.0001", "P = 0.5000")


def test_text_regression_cv_predicts_every_example_once(spark):
    from tests.conftest import SF001
    from turnscore.operators import models as ML
    from turnscore.plans import fixtures as X
    folded = SA.kfold(X.regression_docs(spark, SF001), ["example_id"])
    preds = ML.text_regression_cv(folded, num_features=1 << 10).cache()
    n = folded.count()
    assert preds.count() == n and preds.select("example_id").distinct().count() == n
    m = M.evaluate(preds).first()
    assert m.n == n and math.isfinite(m.mse) and 0.0 <= m.strict_acc <= m.tolerant_acc <= 1.0
    preds.unpersist()


def test_cosine_block_pruning_on_clustered_vectors(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 16))
    rows, vecs = [], []
    for i in range(600):
        v = centers[i % 6] + 0.005 * rng.normal(size=16)
        vecs.append(v)
        rows.append((i, v.tolist(), 0, i % 2 == 1))
    df = spark.createDataFrame(rows, "id LONG, emb ARRAY<DOUBLE>, score INT, synthetic BOOLEAN")
    a = np.array(vecs)
    u = a / np.linalg.norm(a, axis=1, keepdims=True)
    sims = u[0::2] @ u[1::2].T
    ext = SI.cosine_extremes(df, block_rows=16).first()
    assert ext.max_cosine == pytest.approx(float(sims.max()))
    assert ext.min_cosine == pytest.approx(float(sims.min()))
    assert ext.n_pairs == 90000 and ext.pairs_examined < 90000 // 2
    near = SI.near_pairs(df, 0.999, block_rows=16).collect()
    exp = int((sims >= 0.999).sum())
    assert len(near) == exp


def test_fixed_prints_exact_binary_values(spark):
    import random
    from turnscore.functions.text import fixed, formatted
    r = random.Random(1)
    xs = [0.0, -0.0, 0.5, 1.5, 2.5, 0.125, 0.375, 2.885, 5e-21, 5.000000000000001e-21, 1e-300, 5e-324, 1 - 2**-53, 0.99995, 9.99995,
          -0.001, -2.675, 123456789012.125, math.nan, math.inf, -math.inf, 0.00005, 1e16 + 2]
    xs += [r.random() * 10 ** r.randint(-12, 8) * r.choice([1, -1]) for _ in range(100_000)]
    xs += [r.randint(0, 10**6) / 2 ** r.randint(1, 12) for _ in range(20_000)] + [r.randint(0, 10**5) / 1000 for _ in range(20_000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").repartition(4)
    for row in df.select("x", *[fixed("x", n).alias(f"f{n}") for n in (2, 4, 20)]).collect():
        assert [row.f2, row.f4, row.f20] == ["%.2f" % row.x, "%.4f" % row.x, "%.20f" % row.x]
    one = spark.createDataFrame([("a", 2.885, None)], "s string, x double, y double").select(
        formatted("%s: %.2f %%", "s", "x").alias("t"), fixed("y", 3).alias("n")).first()
    assert (one.t, one.n) == ("a: 2.88 %", None)

"""The text learning curve against one separate fit per training set."""

import numpy as np
import pytest

from turnscore import schemas as S
from turnscore.operators import curve as CU
from turnscore.operators import sampling as SA
from turnscore.plans import fixtures as X
from tests.conftest import SF01


def separate_fits(rows, k, fractions, reg):
    """Weights and accuracies of k * len(fractions) least-squares fits, each on its own examples."""
    x = np.array([r.x for r in rows])
    y = np.array([r.label for r in rows], float)
    fold, topic = np.array([r.fold for r in rows]), np.array([r.topic for r in rows])
    steps = np.array([[np.nan if s is None else s for s in r.steps] for r in rows])
    weights, cells = {}, {}
    for f in range(k):
        for step, fraction in enumerate(fractions):
            own = steps[:, f] <= step
            n = own.sum()
            mean, label = x[own].mean(axis=0), y[own].mean()
            a = np.concatenate([x[own] - mean, np.sqrt(n * reg) * np.eye(x.shape[1])])
            w = np.linalg.lstsq(a, np.append(y[own] - label, np.zeros(x.shape[1])), rcond=None)[0]
            weights[f, step] = np.append(w, label - mean @ w)
            p = np.clip(np.rint(x @ w + weights[f, step][-1]), S.SCORE_MIN, S.SCORE_MAX)
            for t in np.unique(topic[fold == f]):
                v = (fold == f) & (topic == t)
                cells[f + 1, fraction, t] = ((p[v] == y[v]).mean(), (np.abs(p[v] - y[v]) <= S.TOLERANCE).mean())
    return weights, cells


def test_curve_equals_separate_fits(spark):
    folded = SA.kfold(X.regression_docs(spark, SF01), ["example_id"])
    feats = CU.curve_features(folded, ["example_id"], "text", "topic", "label", S.N_FOLDS, S.SEED, S.FRACTIONS, 96)
    rows = feats.collect()
    weights, cells = separate_fits(rows, S.N_FOLDS, S.FRACTIONS, 0.01)
    stats = CU.sufficient_statistics(feats, 96, len(S.FRACTIONS))
    got = {(r.outer_fold, r.step): np.array(r.w) for r in CU.ridge_solutions(stats, 96, len(S.FRACTIONS), 0.01).collect()}
    assert got.keys() == weights.keys() and len(got) == 60
    assert max(np.abs(got[key] - weights[key]).max() for key in got) < 1e-6
    curve = CU.learning_curve_text(folded, ["example_id"], num_features=96).collect()
    assert len(curve) == len(cells) == 60 * 4
    for r in curve:
        assert (r.strict_acc, r.flexible_acc) == pytest.approx(cells[r.outer_fold, r.fraction, r.topic], abs=1e-6)


def test_steps_are_the_prefixes(spark):
    folded = SA.kfold(X.regression_docs(spark, SF01), ["example_id"]).drop("text")
    steps = {r.example_id: r.steps for r in SA.nested_steps(folded, ["example_id"]).collect()}
    want = {}
    for r in SA.nested_prefix(folded, ["example_id"]).collect():
        want.setdefault(r.example_id, [None] * S.N_FOLDS)[r.outer_fold] = r.frac_idx
    assert steps == want


def test_odd_examples(spark):
    """Null texts, labels and topics, and prefixes that hold no example."""
    rows = [(i, "good day" if i % 2 else "bad night", "T" if i % 3 else None, 5 if i % 2 else 1) for i in range(12)] + [(12, None, "T", 2), (13, "x", "T", None)]
    df = spark.createDataFrame(rows, "example_id long, text string, topic string, label int")
    folded = SA.kfold(df, ["example_id"])
    got = CU.learning_curve_text(folded, ["example_id"], fractions=[0.01, 0.5], num_features=8).collect()
    assert all(r.strict_acc == 0 == r.flexible_acc for r in got if r.fraction == 0.01) and any(r.strict_acc > 0 for r in got if r.fraction == 0.5)
    assert {r.outer_fold for r in got} == {1, 2, 3, 4, 5} and {r.topic for r in got} == {"T", None}


def test_empty_table(spark):
    df = spark.createDataFrame([], "example_id long, text string, topic string, label int")
    assert CU.learning_curve_text(SA.kfold(df, ["example_id"]), ["example_id"], num_features=4).collect() == []

"""Absolute-error regression: against an independent solver, resumed, and with the best epoch kept."""

import numpy as np
import pytest

from turnscore import schemas as S
from turnscore.operators import absolute as AB
from turnscore.operators import sampling as SA
from turnscore.plans import fixtures as X
from tests.conftest import SF001


@pytest.fixture(scope="module")
def feats(spark):
    folded = SA.kfold(X.regression_docs(spark, SF001), ["example_id"], k=3)
    return AB.text_features(folded, "example_id", "text", "label", "topic", 12)


def objective(x, y, w, reg):
    return np.abs(y - x @ w[:-1] - w[-1]).mean() + reg * (w[:-1] @ w[:-1]) / 2


def admm(x, y, reg, rounds=4000):
    """mean |y - x w - b| + reg |w|^2 / 2, split as r = y - x w - b."""
    n = len(y)
    z = np.concatenate([x, np.ones((n, 1))], axis=1)
    rho = 1.0 / n
    ridge = np.diag([reg] * x.shape[1] + [0.0])
    inv = np.linalg.inv(rho * z.T @ z + ridge + 1e-12 * np.eye(z.shape[1]))
    r = u = np.zeros(n)
    for _ in range(rounds):
        w = inv @ (rho * z.T @ (y - r + u))
        gap = y - z @ w
        r = np.sign(gap + u) * np.maximum(np.abs(gap + u) - 1 / (n * rho), 0)
        u = u + gap - r
    return w


def test_equals_an_independent_solver(feats, tmp_path):
    table = AB.fit_epochs(feats, 3, 12, str(tmp_path / "s"), reg=0.01, epochs=50)
    last = {r.fold: np.array(r.w) for r in AB.chosen_epochs(table, best=False).collect()}
    rows = feats.collect()
    for f in range(3):
        x = np.array([r.x for r in rows if r.fold != f])
        y = np.array([r.label for r in rows if r.fold != f])
        want = admm(x, y, 0.01)
        assert objective(x, y, last[f], 0.01) == pytest.approx(objective(x, y, want, 0.01), abs=1e-4)
        assert np.abs(x @ (last[f] - want)[:-1] + (last[f] - want)[-1]).max() < 0.02


def test_median_that_few_labels_decide(spark, tmp_path):
    """11 more labels lie above the median than below, and 13 on it: plain reweighting stood at 2.011 after 40 epochs."""
    labels = [x for x, n in enumerate([11, 15, 13, 12, 10, 5, 10]) for _ in range(n)]
    near = [0] * 10 + [1] * 40 + [2] * 20 + [3] * 31
    rows = [(i, 1, "a", y) for i, y in enumerate(labels)] + [(100 + i, 1, "b", y) for i, y in enumerate(near)] + [(900, 0, "a", 1), (901, 0, "b", 4)]
    feats = AB.indicator_features(spark.createDataFrame(rows, "id long, fold int, topic string, label int"), "id", "label", "topic", ["a", "b"])
    table = AB.fit_epochs(feats, 2, 2, str(tmp_path / "s"), reg=1e-9, epochs=40, settled=True)
    got = {r.topic: r.pred for r in AB.predictions(feats, AB.chosen_epochs(table, best=False), "m", "id").where("fold = 0").collect()}
    assert got["a"] == pytest.approx(2, abs=2e-4) and got["b"] == pytest.approx(np.median(near), abs=2e-4)


def test_resumed_fit_is_the_same(feats, tmp_path, spark):
    whole = AB.fit_epochs(feats, 3, 12, str(tmp_path / "a"), epochs=8)
    AB.fit_epochs(feats, 3, 12, str(tmp_path / "b"), epochs=3)
    # a driver lost while it wrote epoch 4: one fold's row only
    whole.where("epoch = 4 and fold = 1").coalesce(1).write.parquet(str(tmp_path / "b" / "part=4"))
    again = AB.fit_epochs(feats, 3, 12, str(tmp_path / "b"), epochs=8)
    key = lambda t: {(r.epoch, r.fold): (list(r.w), r.train_loss, r.validation_loss) for r in t.collect()}
    a, b = key(whole), key(again)
    assert a.keys() == b.keys() and len(a) == 27
    for k in a:
        assert np.allclose(a[k][0], b[k][0], atol=1e-9) and a[k][1:] == pytest.approx(b[k][1:], abs=1e-12)


def test_best_epoch_is_restored(feats, tmp_path):
    table = AB.fit_epochs(feats, 3, 12, str(tmp_path / "s"), epochs=6)
    rows = table.collect()
    for r in AB.chosen_epochs(table, best=True).collect():
        own = [x for x in rows if x.fold == r.fold]
        assert min(x.validation_loss for x in own) == next(x.validation_loss for x in own if x.epoch == r.epoch)
        assert list(r.w) == list(next(x.w for x in own if x.epoch == r.epoch))


def test_squared_loss_is_ridge(feats, tmp_path):
    table = AB.fit_epochs(feats, 3, 12, str(tmp_path / "s"), loss="squared", reg=0.1, epochs=4)
    w = {r.fold: np.array(r.w) for r in AB.chosen_epochs(table, best=False).collect()}
    rows = feats.collect()
    x, y = np.array([r.x for r in rows if r.fold != 0]), np.array([r.label for r in rows if r.fold != 0])
    a = np.concatenate([x - x.mean(axis=0), np.sqrt(len(y) * 0.05) * np.eye(12)])
    want = np.linalg.lstsq(a, np.append(y - y.mean(), np.zeros(12)), rcond=None)[0]
    assert np.allclose(w[0][:-1], want, atol=1e-8)


def test_predictions_and_empty_table(spark):
    folded = SA.kfold(X.regression_docs(spark, SF001), ["example_id"])
    got = AB.text_absolute_cv(folded, num_features=8, epochs=3)
    assert got.select("example_id").distinct().count() == got.count() == folded.count()
    assert AB.text_absolute_cv(folded.limit(0), num_features=4, epochs=2).collect() == []

"""Exact cosine extremes by search in a metric tree."""

import numpy as np
import pytest

from turnscore.operators import metric_tree as MT
from turnscore.operators import similarity as SI

SCHEMA = "id LONG, emb ARRAY<DOUBLE>, synthetic BOOLEAN"


def table(spark, vectors):
    return spark.createDataFrame([(i, v.tolist(), i % 2 == 1) for i, v in enumerate(vectors)], SCHEMA)


def cosines(vectors):
    n = np.linalg.norm(vectors, axis=1, keepdims=True)
    u = np.divide(vectors, n, out=np.zeros_like(vectors), where=n > 0)
    return u[0::2] @ u[1::2].T


def clustered(n, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(24, 16))
    return centres[rng.integers(24, size=n)] + 0.02 * rng.normal(size=(n, 16))


def check(ext, sims):
    assert ext.max_cosine == pytest.approx(float(sims.max())) and ext.min_cosine == pytest.approx(float(sims.min()))
    assert sims[ext.max_pair.real_id // 2, ext.max_pair.synthetic_id // 2] == pytest.approx(ext.max_cosine)
    assert sims[ext.min_pair.real_id // 2, ext.min_pair.synthetic_id // 2] == pytest.approx(ext.min_cosine)
    assert ext.n_pairs == sims.size and 0 < ext.pairs_examined <= sims.size


def test_share_of_pairs_falls_as_the_table_grows(spark):
    shares = []
    for n in (500, 4000):
        v = clustered(n)
        ext = SI.cosine_extremes(table(spark, v), block_rows=32).first()
        check(ext, cosines(v))
        shares.append(ext.pairs_examined / ext.n_pairs)
    assert shares[1] < 0.5 * shares[0] < 0.5


def test_deep_tree_with_repeated_and_zero_vectors(spark):
    v = np.concatenate([np.repeat([[1.0, 2.0, 3.0]], 120, axis=0), np.zeros((6, 3)), np.random.default_rng(1).normal(size=(20, 3)) ** 3])
    tree = SI._tree(table(spark, v), "synthetic", "id", "emb", 4)
    assert tree.leaves.selectExpr("max(size(ids))").first()[0] <= 10  # 60 equal vectors a side are dealt by hash
    assert sorted(i for r in tree.leaves.collect() for i in r.ids) == list(range(len(v)))
    assert tree.children.selectExpr("max(size(split(node, '[.]')))").first()[0] >= 3
    check(SI.cosine_extremes(table(spark, v), block_rows=4).first(), cosines(v))


def test_bounds_hold(spark):
    v = clustered(300, 7)
    tree, sims = SI._tree(table(spark, v), "synthetic", "id", "emb", 8), cosines(v)
    ids = {r.node: r.ids for r in tree.leaves.collect()}
    for r in MT.search(tree, lambda p: p, "all").collect():
        block = sims[np.ix_([i // 2 for i in ids[r.a]], [i // 2 for i in ids[r.b]])]
        assert r.lb <= block.min() and block.max() <= r.ub


def test_one_side_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], False)], SCHEMA)
    ext = SI.cosine_extremes(df).first()
    assert ext.max_cosine is None and ext.n_pairs == 0 and SI.near_pairs(df, 0.5).collect() == []


@pytest.mark.parametrize("threshold", [0.9, 0.97])
def test_hashing_finds_nine_tenths_of_near_pairs(spark, threshold):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 32))
    v = np.concatenate([base[rng.integers(150, size=900)] + 0.3 * rng.normal(size=(900, 32)) * rng.random((900, 1)), np.zeros((4, 32))])
    df, sims = table(spark, v), cosines(v)
    want = {(2 * i, 2 * j + 1) for i, j in zip(*np.nonzero(sims >= threshold))}
    got = {(r.real_id, r.synthetic_id): r.cosine for r in SI.near_pairs_hashed(df, threshold).collect()}
    assert set(got) <= want and len(got) >= 0.9 * len(want) and len(want) > 200
    assert all(sims[a // 2, b // 2] == pytest.approx(c) for (a, b), c in got.items())


def shuffled(plan):
    """Bytes that the exchanges of an executed plan wrote."""
    kind, m = plan.getClass().getSimpleName(), plan.metrics()
    total = m.apply("shuffleBytesWritten").value() if m.contains("shuffleBytesWritten") else 0
    if kind == "AdaptiveSparkPlanExec":
        return total + shuffled(plan.finalPhysicalPlan())
    if kind.endswith("QueryStageExec"):
        return total + shuffled(plan.plan())
    return total + sum(shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


def test_vectors_shuffled_grow_as_the_table_when_nothing_is_pruned(spark):
    moved = []
    for n in (100, 400):
        v = np.random.default_rng(2).normal(size=(n, 32))
        near = SI.near_pairs(table(spark, v), -1.0, block_rows=8)
        assert len(near.collect()) == n * n // 4
        moved.append(shuffled(near._jdf.queryExecution().executedPlan()))
    assert moved[1] < 7 * moved[0]


def test_vectors_shuffled_for_hashing_grow_as_the_table_when_all_meet(spark):
    moved = []
    for n in (100, 400):
        v = 1 + 0.01 * np.random.default_rng(2).normal(size=(n, 32))
        near = SI.near_pairs_hashed(table(spark, v), 0.9)
        assert 0.9 * n * n // 4 <= len({(r.real_id, r.synthetic_id) for r in near.collect()}) <= n * n // 4
        moved.append(shuffled(near._jdf.queryExecution().executedPlan()))
    assert moved[1] < 7 * moved[0]


def test_null_vectors_have_no_pairs_and_shift_no_ids(spark):
    v = np.random.default_rng(4).normal(size=(40, 8))
    df = spark.createDataFrame([(i, None if i % 5 == 0 else x.tolist(), i % 2 == 1) for i, x in enumerate(v)], SCHEMA)
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j): n[i] @ n[j] for i in range(0, 40, 2) for j in range(1, 40, 2) if i % 5 and j % 5}
    got = {(r.real_id, r.synthetic_id): r.cosine for r in SI.near_pairs(df, -1.0, block_rows=64).collect()}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)


def crossed(tree, **limits):
    """(real id, synthetic id) of every vector pair that ``products`` multiplies."""
    def each(found):
        import pyarrow as pa
        for a, b, m in found:
            i, j = np.indices(m.shape)
            yield pa.RecordBatch.from_arrays([a.take(pa.array(i.ravel())), b.take(pa.array(j.ravel()))], ["r", "s"])
    rows = [tuple(x) for x in MT.products(tree, each, "r long, s long", **limits).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("low,high", [(-0.6, 0.95), (-2.0, -1.0)])
def test_products_reach_the_pairs_of_a_search(spark, low, high):
    v = np.concatenate([clustered(300, 3), np.zeros((6, 16)), np.repeat([[1.0] * 16], 40, axis=0)])
    tree = SI._tree(table(spark, v), "synthetic", "id", "emb", 8)
    ids = {r.no: r.ids for r in tree.leaves.collect()}
    pairs = [(r.no_a, r.no_b) for r in MT.search(tree, lambda p: p.where((p.ub >= high) | (p.lb <= low)), "reached").collect()]
    want = {(x, y) for a, b in pairs for x in ids[a] for y in ids[b]}
    assert crossed(tree, low=low, high=high) == want and (high == -1.0) == (len(want) == (len(v) // 2) ** 2)
    out = pairs[::3]
    assert crossed(tree, low=low, high=high, without=out) == want - {(x, y) for a, b in out for x in ids[a] for y in ids[b]}
    assert crossed(tree, pairs=out) == {(x, y) for a, b in out for x in ids[a] for y in ids[b]}


def test_no_table_of_pairs_when_nothing_is_pruned(spark, monkeypatch):
    written, write = [], MT.materialize

    def counted(df, name="table"):
        out = write(df, name)
        written.append((out.count(), name))
        return out
    monkeypatch.setattr(MT, "materialize", counted), monkeypatch.setattr(SI, "materialize", counted)
    v = np.random.default_rng(2).normal(size=(400, 32))
    assert SI.near_pairs(table(spark, v), -1.0, block_rows=4).count() == 200 * 200
    assert max(written)[0] <= 3 * 400  # nodes and vectors; pairs of leaves are tens of thousands

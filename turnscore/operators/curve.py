"""Learning curve of a text regression from nested sufficient statistics.

A ridge regression needs of its training set only the Gram matrix, the moment vector
and the counts. Training sets of the curve are nested prefixes, so one pass over the
features sums these per (outer fold, prefix step), cumulative sums over the steps give
every training set, and each fit is one solve of bounded size. Nothing is fitted by
iterating over the examples, and no example is read once per fit.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscore import schemas as S
from turnscore.operators.models import _features
from turnscore.operators.sampling import nested_steps
from turnscore.session import materialize

#: Features of the curve's regression: a solve holds the square of it.
CURVE_FEATURES = 512
#: Columns of the Gram matrix in one summed row.
_STRIP = 64


def curve_features(folded: DataFrame, keys: Sequence[str], text: str, topic: str, label: str, k: int, seed,
                   fractions: Sequence[float], num_features: int) -> DataFrame:
    """Written table (fold, topic, label, steps, x): hashed term counts of unit length (zero without
    terms), and the prefix step per outer fold."""
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import vector_to_array
    steps = nested_steps(folded.select(*dict.fromkeys([*keys, "fold", "n_total", topic, label, text])), keys, k, seed, fractions)
    terms = _features(steps.withColumn(text, F.coalesce(F.col(text), F.lit(""))), text, num_features)
    unit = Normalizer(inputCol="tf", outputCol="unit", p=2.0).transform(terms)
    return materialize(unit.select("fold", F.col(topic).alias("topic"), F.col(label).cast("int").alias("label"), "steps",
                                   vector_to_array("unit").alias("x")), "curve-features")


def sufficient_statistics(feats: DataFrame, num_features: int, steps: int) -> DataFrame:
    """(outer_fold, step, strip, packed): per outer fold and prefix step the sums over its examples of z z^T,
    z = (x, 1, y), by strips of rows. One pass; a task keeps at most one matrix per fold and step,
    and the matrices are added up in two rounds."""
    side = num_features + 2
    strips = -(-side // _STRIP)

    def gram(batches):
        import numpy as np
        import pyarrow as pa
        sums = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.concatenate([batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1), np.ones((n, 1)),
                                batch.column("label").to_numpy(zero_copy_only=False).astype(float)[:, None]], axis=1)
            at = batch.column("steps").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
            for f in range(at.shape[1]):
                for step in np.unique(at[:, f][~np.isnan(at[:, f])]).astype(int):
                    z = x[at[:, f] == step]
                    sums[f, step] = sums.get((f, step), 0.0) + z.T @ z
        for (f, step), m in sums.items():
            rows = [m[i * _STRIP:(i + 1) * _STRIP].tobytes() for i in range(strips)]
            yield pa.RecordBatch.from_arrays([pa.array([f] * strips, pa.int32()), pa.array([step] * strips, pa.int32()),
                                              pa.array(range(strips), pa.int32()), pa.array(rows, pa.binary())], names)

    def add(key, table):
        import numpy as np
        import pyarrow as pa
        total = sum(np.frombuffer(x.as_py()) for x in table.column("packed"))
        return pa.table({"outer_fold": pa.array([key[0].as_py()], pa.int32()), "step": pa.array([key[1].as_py()], pa.int32()),
                         "strip": pa.array([key[2].as_py()], pa.int32()), "packed": pa.array([total.tobytes()], pa.binary())})

    names = ["outer_fold", "step", "strip", "packed"]
    schema = "outer_fold int, step int, strip int, packed binary"
    few = max(8, feats.sparkSession.sparkContext.defaultParallelism)
    parts = feats.select("x", "label", "steps").coalesce(few).mapInArrow(gram, schema)
    # a strip has a row per task, so some tasks' rows are added up before all meet
    parts = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    first = parts.groupBy("outer_fold", "step", "strip", "salt").applyInArrow(add, schema)
    return materialize(first.groupBy("outer_fold", "step", "strip").applyInArrow(add, schema), "curve-statistics")


def ridge_solutions(stats: DataFrame, num_features: int, n_steps: int, reg: float) -> DataFrame:
    """(outer_fold, step, n, w): ridge weights and, as the last, the intercept for the examples of all steps up
    to each one; no row where there are none. Minimises |y - x w - b|^2 / (2 n) + reg * |w|^2 / 2. An outer
    fold's matrices (n_steps of (num_features + 2)^2 doubles) meet in one task."""
    side = num_features + 2

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        m, out = np.zeros((side, side)), []
        by_step = {s: x.sort_values("strip") for s, x in frame.groupby("step")}
        for step in range(n_steps):
            if step in by_step:
                m += np.concatenate([np.frombuffer(p).reshape(-1, side) for p in by_step[step]["packed"]])
            n = m[-2, -2]
            if n == 0:
                continue
            mean, label = m[-2, :-2] / n, m[-2, -1] / n
            gram = m[:-2, :-2] / n - np.outer(mean, mean) + reg * np.eye(num_features)
            w = np.linalg.solve(gram, m[:-2, -1] / n - mean * label)
            out.append((int(frame["outer_fold"].iloc[0]), step, int(n), [*w.tolist(), float(label - mean @ w)]))
        return pd.DataFrame(out, columns=["outer_fold", "step", "n", "w"])

    return materialize(stats.groupBy("outer_fold").applyInPandas(solve, "outer_fold int, step int, n long, w array<double>"), "curve-weights")


def learning_curve_text(folded: DataFrame, keys: Sequence[str], text: str = "text", topic: str = "topic", label: str = "label",
                        k: int = S.N_FOLDS, seed=S.SEED, fractions: Sequence[float] = S.FRACTIONS,
                        num_features: int = CURVE_FEATURES, reg: float = 0.01, tol: int = S.TOLERANCE) -> DataFrame:
    """Learning curve of a ridge regression on hashed terms: outer_fold (1-based), fraction, topic,
    strict_acc, flexible_acc for the topics of each validation fold.

    ``folded`` has ``fold`` and ``n_total`` (from ``kfold``). Examples without a label do not train and count as
    missed; null text has no terms. A fraction without training examples misses all. Features are
    written once; one pass sums all k * len(fractions) training sets, one more scores every example
    with the models of its own fold (at most k * len(fractions) * num_features numbers, broadcast)."""
    feats = curve_features(folded, keys, text, topic, label, k, seed, fractions, num_features)
    stats = sufficient_statistics(feats.where("label is not null"), num_features, len(fractions))
    n_steps = len(fractions)
    weights = ridge_solutions(stats, num_features, n_steps, reg)
    top = S.SCORE_MAX
    table = {(r.outer_fold, r.step): r.w for r in weights.select("outer_fold", "step", "w").collect()}  # bounded, see above
    shared = feats.sparkSession.sparkContext.broadcast(table)

    def score(batches):
        import numpy as np
        import pyarrow as pa
        models = shared.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.concatenate([batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1), np.ones((n, 1))], axis=1)
            fold = batch.column("fold").to_numpy(zero_copy_only=False).astype(int)
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            topics = np.array(["" if t is None else "x" + t for t in batch.column("topic").to_pylist()], dtype=object)
            rows = []
            for f in np.unique(fold):
                own = fold == f
                names, which = np.unique(topics[own].astype(str), return_inverse=True)
                size = np.bincount(which)
                for step in range(n_steps):
                    hit = near = np.zeros(len(which), bool)
                    if (f, step) in models:
                        p = np.clip(np.rint(x[own] @ np.array(models[f, step])), 0, top)
                        hit, near = p == y[own], np.abs(p - y[own]) <= tol
                    for i, t in enumerate(names):
                        rows.append((int(f), step, t[1:] if t else None, int(size[i]), int(hit[which == i].sum()), int(near[which == i].sum())))
            cols = list(zip(*rows))
            types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["fold", "step", "topic", "n", "hit", "near"])

    counted = feats.select("x", "fold", "label", "topic").mapInArrow(
        score, "fold int, step int, topic string, n long, hit long, near long")
    cells = counted.groupBy("fold", "step", "topic").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"), F.sum("near").alias("near"))
    return cells.select((F.col("fold") + 1).alias("outer_fold"),
                        F.element_at(F.array(*[F.lit(float(x)) for x in fractions]), F.col("step") + 1).alias("fraction"), "topic",
                        (F.col("hit") / F.col("n")).alias("strict_acc"), (F.col("near") / F.col("n")).alias("flexible_acc"))

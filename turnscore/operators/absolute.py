"""Linear regression with absolute or squared loss, epoch by epoch.

The absolute loss is smoothed to sqrt(r^2 + eps^2), whose minimum follows from least-squares
steps with the weights 1 / sqrt(r^2 + eps^2); eps halves every epoch down to ``EPS``. A step
is one pass over the written features: every task sums the weighted Gram matrices of all folds,
sums meet in two steps, and one bounded solve per fold gives the next weights. The pass also
measures the loss of the current weights on each fold's training and validation examples.

An epoch is one such step, which leads downhill but crawls to a median that few labels decide. A
settled fit goes on within an epoch until the smoothed objective of every fold has settled, by steps
that mix in the true curvature; one that leads uphill is taken back and damped more.

An epoch's weights and losses are a small table of their own in shared
storage, so a lost driver resumes after the last complete epoch and gets the same model, and the
epoch with the least validation loss can be restored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscore import schemas as S
from turnscore.operators.models import _features
from turnscore.session import materialize, shared_path

EPS, EPOCHS = 1e-6, 60
#: A fold has settled when its next step would gain less than this share of eps.
SETTLED = 0.01
EPOCH_SCHEMA = "epoch int, fold int, w array<double>, eps double, n_train long, train_loss double, n_validation long, validation_loss double"


def text_features(folded: DataFrame, key: str, text: str, label: str, topic: str, num_features: int) -> DataFrame:
    """Written table (key, fold, topic, label, x): hashed term counts of unit length; null text has no terms."""
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import vector_to_array
    known = folded.select(key, "fold", topic, label, F.coalesce(F.col(text), F.lit("")).alias(text))
    unit = Normalizer(inputCol="tf", outputCol="unit", p=2.0).transform(_features(known, text, num_features))
    return materialize(unit.select(F.col(key).alias("key"), "fold", F.col(topic).alias("topic"), F.col(label).cast("double").alias("label"),
                                   vector_to_array("unit").alias("x")), "regression-features")


def indicator_features(folded: DataFrame, key: str, label: str, topic: str, topics: Sequence[str]) -> DataFrame:
    """Written table (key, fold, topic, label, x): one feature per topic."""
    x = F.array(*[F.when(F.col(topic) == t, 1.0).otherwise(0.0) for t in topics])
    return materialize(folded.select(F.col(key).alias("key"), "fold", F.col(topic).alias("topic"), F.col(label).cast("double").alias("label"),
                                     x.alias("x")), "indicator-features")


def _pass(feats: DataFrame, weights: np.ndarray, eps: float | None, curved: bool) -> list[tuple]:
    """(fold, n_train, train loss, n_validation, validation loss, smoothed train loss, its negative slope, Gram matrix of
    (x, 1) weighted by 1 / sqrt(r^2 + eps^2), if ``curved`` also by the curvature) of every fold, by one pass; without
    ``eps`` the loss is squared. All but the numbers of examples are means."""
    k, side = weights.shape
    shared = feats.sparkSession.sparkContext.broadcast(weights)
    schema = "fold int, packed binary"

    def sums(batches):
        import numpy as np
        import pyarrow as pa
        w, total = shared.value, np.zeros((k, 5 + side + (1 + curved) * side * side))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            z = np.concatenate([batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1), np.ones((n, 1))], axis=1)
            y = batch.column("label").to_numpy(zero_copy_only=False)
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for f in range(k):
                r = y - z @ w[f]
                own = fold == f
                loss = np.abs(r) if eps is not None else r * r
                total[f, :4] += [n - own.sum(), loss[~own].sum(), own.sum(), loss[own].sum()]
                x, r = z[~own], r[~own]
                smooth = np.sqrt(r * r + eps * eps) if eps is not None else r * r
                upper = 1 / smooth if eps is not None else np.full(len(r), 2.0)
                total[f, 4] += smooth.sum()
                grams = [upper, upper * (eps / smooth) ** 2] if curved else [upper]
                total[f, 5:] += np.concatenate([x.T @ (upper * r), *[((x * a[:, None]).T @ x).ravel() for a in grams]])
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["fold", "packed"])

    def add(key, table):
        import numpy as np
        import pyarrow as pa
        total = sum(np.frombuffer(x.as_py()) for x in table.column("packed"))
        return pa.table({"fold": pa.array([key[0].as_py()], pa.int32()), "packed": pa.array([total.tobytes()], pa.binary())})

    few = max(8, feats.sparkSession.sparkContext.defaultParallelism)
    parts = feats.where("label is not null").select("x", "fold", "label").coalesce(few).mapInArrow(sums, schema)
    parts = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16))).groupBy("fold", "salt").applyInArrow(add, schema)
    out = []
    for r in sorted(parts.groupBy("fold").applyInArrow(add, schema).collect()):  # one row a fold
        v = np.frombuffer(bytes(r.packed))
        n = max(1, v[0])
        out.append((r.fold, int(v[0]), v[1] / n, int(v[2]), v[3] / max(1, v[2]), v[4] / n, v[5:5 + side] / n,
                    *(v[5 + side:] / n).reshape(-1, side, side)))
    return out


def _ridge(reg: float, side: int) -> np.ndarray:
    ridge = reg * np.eye(side)
    ridge[-1, -1] = 0
    return ridge


def _step(weights: np.ndarray, reg: float, stats: list[tuple]) -> np.ndarray:
    """The weights after one step of every fold; ``stats`` is the pass at ``weights``."""
    weights, ridge = weights.copy(), _ridge(reg, weights.shape[1])
    for f, n, _, _, _, _, slope, upper, *_ in stats:
        if n:
            weights[f] += np.linalg.lstsq(upper + ridge, slope - ridge @ weights[f], rcond=None)[0]
    return weights


def _settle(feats: DataFrame, weights: np.ndarray, eps: float, reg: float, stats: list[tuple]) -> np.ndarray:
    """The weights that minimise every fold's objective at ``eps``; ``stats`` is the pass at ``weights``. Damped fully, a
    step gains at least what it promises, so the steps end; one that does not then is at the limit of the numbers."""
    weights, ridge = weights.copy(), _ridge(reg, weights.shape[1])
    value = lambda w, s: s[5] + w @ ridge @ w / 2
    now = {s[0]: s for s in stats if s[1]}
    damp = dict.fromkeys(now, 0.5)
    while now:
        trial = weights.copy()
        for f, (*_, slope, upper, curve) in list(now.items()):
            down = slope - ridge @ weights[f]
            step = np.linalg.lstsq(damp[f] * upper + (1 - damp[f]) * curve + ridge, down, rcond=None)[0]
            if down @ step / 2 <= SETTLED * eps:
                del now[f]
            else:
                trial[f] += step
        for new in _pass(feats, trial, eps, True) if now else ():
            f = new[0]
            if f not in now:
                continue
            if value(trial[f], new) <= value(weights[f], now[f]):
                weights[f], now[f], damp[f] = trial[f], new, max(1e-4, damp[f] / 4)
            elif damp[f] < 1:
                damp[f] = min(1.0, damp[f] * 4)
            else:
                del now[f]
    return weights


def _done(spark, state: str, k: int) -> dict[int, list]:
    """The complete epochs of a state folder: those with a row for every fold."""
    from pyspark.errors import AnalysisException
    try:
        rows = spark.read.schema(EPOCH_SCHEMA).parquet(state).collect()  # k rows an epoch
    except AnalysisException:  # no folder yet
        return {}
    epochs: dict[int, list] = {}
    for r in rows:
        epochs.setdefault(r.epoch, []).append(r)
    return {e: sorted(x, key=lambda r: r.fold) for e, x in epochs.items() if len(x) == k}


def fit_epochs(feats: DataFrame, k: int, num_features: int, state: str, loss: str = "absolute", reg: float = 1e-3, epochs: int = EPOCHS,
               tol: float = 1e-10, settled: bool = False) -> DataFrame:
    """The table of epochs (EPOCH_SCHEMA) of ``k`` fits, fold f held out of the f-th: losses of the weights that an
    epoch began with, epoch 0 with zeros. Minimises mean(loss) + reg * |w|^2 / 2, the intercept (last weight) free.

    Epochs already complete in ``state`` (a folder in shared storage) are kept and the fit goes on behind
    the last one. It ends after ``epochs`` or once no fold's training loss changes by more than ``tol`` of it. An
    absolute fit that must reach the minimum, whatever the number of passes, is to be ``settled``."""
    spark = feats.sparkSession
    done = _done(spark, state, k)
    at, curved = max(done, default=-1), settled and loss == "absolute"
    stats = None  # of the weights and eps of the last epoch, unless another driver made it
    start = feats.agg(F.coalesce(F.expr("percentile_approx(label, 0.5)"), F.lit(0.0))).first()[0]
    while at < epochs:
        if at < 0:
            weights = np.zeros((k, num_features + 1))
            weights[:, -1] = start
        else:
            last = done[at]
            eps = last[0].eps if loss == "absolute" else None
            weights = np.array([r.w for r in last])
            if at > 1 and (eps is None or eps <= EPS) and all(
                    abs(r.train_loss - p.train_loss) <= tol * max(1e-12, p.train_loss) for r, p in zip(last, done[at - 1])):
                break
            stats = stats or _pass(feats, weights, eps, curved)
            weights = _settle(feats, weights, eps, reg, stats) if curved else _step(weights, reg, stats)
        at += 1
        eps = max(EPS, 0.5 ** at)
        stats = _pass(feats, weights, eps if loss == "absolute" else None, curved)
        rows = [(at, f, weights[f].tolist(), eps, n, float(a), v, float(b)) for f, n, a, v, b, *_ in stats]
        spark.createDataFrame(rows, EPOCH_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{state}/part={at}")
        done[at] = sorted(spark.createDataFrame(rows, EPOCH_SCHEMA).collect(), key=lambda r: r.fold)
    return spark.read.schema(EPOCH_SCHEMA).parquet(state)


def chosen_epochs(table: DataFrame, best: bool) -> DataFrame:
    """(fold, epoch, w): per fold the epoch with the least validation loss (the first of equal ones), or the last one."""
    order = F.struct(F.col("validation_loss"), F.col("epoch")) if best else F.struct(-F.col("epoch"))
    return table.groupBy("fold").agg(F.min_by("epoch", order).alias("epoch"), F.min_by("w", order).alias("w"))


def predictions(feats: DataFrame, chosen: DataFrame, model: str, key: str) -> DataFrame:
    """Out-of-fold prediction table; ``chosen`` has one row a fold."""
    w = chosen.select("fold", "w")
    score = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    x1 = F.array_append("x", F.lit(1.0))
    return feats.withColumn("x", x1).join(F.broadcast(w), "fold").select(
        F.col("key").alias(key), F.lit(model).alias("model"), F.col("fold").cast("int").alias("fold"), "topic",
        F.col("label").cast("int").alias("label"), score.alias("pred"))


def text_absolute_cv(folded: DataFrame, key: str = "example_id", text: str = "text", label: str = "label", topic: str = "topic",
                     k: int = S.N_FOLDS, num_features: int = 256, reg: float = 1e-3, epochs: int = EPOCHS, best: bool = True,
                     model_name: str = "text_absolute", models_path: str | None = None) -> DataFrame:
    """Out-of-fold predictions of a text regression with absolute loss (ML4), the best epoch of each fold kept (ML3,
    SK9). With ``models_path`` epochs stay there, a stopped fit resumes, and ``models_path``/best holds the kept weights."""
    feats = text_features(folded, key, text, label, topic, num_features)
    state = f"{models_path}/epochs" if models_path else shared_path(folded.sparkSession, "epochs")
    chosen = chosen_epochs(fit_epochs(feats, k, num_features, state, "absolute", reg, epochs), best)
    if models_path:
        chosen.coalesce(1).write.mode("overwrite").parquet(f"{models_path}/best")
    return predictions(feats, chosen, model_name, key)

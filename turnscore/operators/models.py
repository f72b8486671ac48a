"""Model-shaped table work: cross-validated mean predictors, learning curves,
Spark ML text regression per fold, and a batched model map.

Constant-per-slice predictors (topic means) are evaluated from label
histograms: the examples are aggregated once to (slice, label) counts and all
later arithmetic runs on that small table instead of joining predictions back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnscore import schemas as S
from turnscore.functions.ordinal import to_ordinal
from turnscore.operators.sampling import nested_prefix
from turnscore.sources.writers import save_model


def histogram_metrics(pred: str = "pred", label: str = "label", cnt: str = "cnt",
                      tol: int = S.TOLERANCE) -> dict[str, Column]:
    """Aggregates over a (by..., label, cnt, pred) histogram equal to the per-row
    metrics of a prediction that is constant within each histogram row."""
    p = F.col(pred).cast("double")
    y = F.col(label).cast("double")
    c = F.col(cnt).cast("double")
    strict = to_ordinal(p)
    n = F.sum(c)
    exprs = {
        "n": F.sum(F.col(cnt)).cast("bigint"),
        "mse": F.sum(c * (p - y) * (p - y)) / n,
        "mae": F.sum(c * F.abs(p - y)) / n,
        "strict_acc": F.sum(F.when(strict == F.col(label), c).otherwise(F.lit(0.0))) / n,
        "tolerant_acc": F.sum(F.when(F.abs(strict - F.col(label)) <= tol, c).otherwise(F.lit(0.0))) / n,
    }
    return {name: e.alias(name) for name, e in exprs.items()}


def topic_mean_cv_means(folded: DataFrame, topic: str = "topic", label: str = "label",
                        fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Out-of-fold topic means by subtraction: one aggregation by (fold, topic, label)
    and no per-fold re-scan. Returns (histogram, means per (fold, topic)); a topic
    absent from the training folds gets the global training mean."""
    from turnscore.session import materialize
    hist = folded.groupBy(F.col(fold).alias("fold"), F.col(topic).alias("topic"),
                          F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("cnt"))
    hist = materialize(hist, "fold-histogram")  # folds x topics x labels rows, read by several branches
    ft = hist.groupBy("fold", "topic").agg(
        F.sum(F.col("label") * F.col("cnt")).alias("s_ft"), F.sum("cnt").alias("c_ft"))
    by_topic = Window.partitionBy("topic")
    by_fold = Window.partitionBy("fold")
    everything = Window.partitionBy()
    # ft has at most folds x topics rows, so these windows are over a small table
    means = ft.select(
        "fold", "topic",
        (F.sum("s_ft").over(by_topic) - F.col("s_ft")).alias("s_t"),
        (F.sum("c_ft").over(by_topic) - F.col("c_ft")).alias("c_t"),
        (F.sum("s_ft").over(everything) - F.sum("s_ft").over(by_fold)).alias("s_all"),
        (F.sum("c_ft").over(everything) - F.sum("c_ft").over(by_fold)).alias("c_all"))
    means = means.select(
        "fold", "topic",
        F.when(F.col("c_t") > 0, F.col("s_t") / F.col("c_t"))
        .otherwise(F.try_divide(F.col("s_all"), F.col("c_all"))).alias("train_mean"))
    return hist, means


def topic_mean_cv(folded: DataFrame, topic: str = "topic", label: str = "label",
                  fold: str = "fold") -> DataFrame:
    """Cross-validated per-topic mean predictor: metrics per (fold, topic) and per
    fold overall (topic 'ALL'), with the training mean used."""
    hist, means = topic_mean_cv_means(folded, topic, label, fold)
    h = hist.join(means, ["fold", "topic"])
    per_topic = h.groupBy("fold", "topic", "train_mean").agg(
        *histogram_metrics(pred="train_mean").values())
    overall = h.groupBy("fold").agg(*histogram_metrics(pred="train_mean").values()) \
        .select("fold", F.lit("ALL").alias("topic"), F.lit(None).cast("double").alias("train_mean"),
                "n", "mse", "mae", "strict_acc", "tolerant_acc")
    return per_topic.unionByName(overall)


def topic_mean_cv_predictions(folded: DataFrame, key: str = "example_id", topic: str = "topic",
                              label: str = "label", fold: str = "fold",
                              model: str = "topic_mean") -> DataFrame:
    """Row-level out-of-fold predictions (prediction-table form, ML8)."""
    _, means = topic_mean_cv_means(folded, topic, label, fold)
    return folded.select(key, F.col(fold).alias("fold"), F.col(topic).alias("topic"),
                         F.col(label).cast("int").alias("label")) \
        .join(means, ["fold", "topic"]) \
        .select(key, F.lit(model).alias("model"), "fold", "topic", "label",
                F.col("train_mean").alias("pred"))


def learning_curve_mean(folded: DataFrame, keys: Sequence[str], topic: str = "topic",
                        label: str = "label", k: int = S.N_FOLDS, seed=S.SEED,
                        fractions: Sequence[float] = S.FRACTIONS, materialize: bool = True) -> DataFrame:
    """Nested-subset learning curve of the per-topic mean predictor in one pass.

    Each pool row gets the smallest fraction whose prefix holds it; sums per
    (outer_fold, frac_idx, topic) accumulated over frac_idx give the training
    means of all k x len(fractions) subsets; the validation fold is scored from
    its (topic, label) histogram. Output: outer_fold (1-based), fraction, topic,
    strict_acc, flexible_acc for the topics of each validation fold."""
    from turnscore.session import materialize as written
    nf = len(fractions)
    pools = nested_prefix(folded, keys, k, seed, fractions)
    # the one pass over the pools; folds x fractions x topics x folds x labels rows
    small = pools.groupBy("outer_fold", "frac_idx", "fold", F.col(topic).alias("topic"), F.col(label).cast("int").alias("label")) \
        .agg(F.count(F.lit(1)).alias("cnt"))
    if materialize:
        small = written(small, "curve-counts")
    train = small.where(F.col("frac_idx").isNotNull()).groupBy("outer_fold", "frac_idx", "topic").agg(
        F.sum(F.col("label").cast("long") * F.col("cnt")).alias("s"), F.sum("cnt").alias("c"))
    spine = train.select("outer_fold", "topic").distinct() \
        .withColumn("frac_idx", F.explode(F.sequence(F.lit(0), F.lit(nf - 1))))
    cum_w = Window.partitionBy("outer_fold", "topic").orderBy("frac_idx") \
        .rowsBetween(Window.unboundedPreceding, 0)
    cum = spine.join(train, ["outer_fold", "frac_idx", "topic"], "left").select(
        "outer_fold", "frac_idx", "topic",
        F.sum(F.coalesce("s", F.lit(0))).over(cum_w).alias("s_t"),
        F.sum(F.coalesce("c", F.lit(0))).over(cum_w).alias("c_t"))
    glob = cum.groupBy("outer_fold", "frac_idx").agg(F.sum("s_t").alias("s_g"), F.sum("c_t").alias("c_g"))
    # every example is in the pool of the fold after its own exactly once
    val = small.where(F.col("outer_fold") == F.pmod(F.col("fold") + 1, F.lit(k))).groupBy(
        F.col("fold").alias("outer_fold"), "topic", "label").agg(F.sum("cnt").alias("cnt"))
    val_spine = val.withColumn("frac_idx", F.explode(F.sequence(F.lit(0), F.lit(nf - 1))))
    scored = val_spine.join(cum, ["outer_fold", "frac_idx", "topic"], "left") \
        .join(glob, ["outer_fold", "frac_idx"], "left") \
        .withColumn("pred", F.when(F.col("c_t") > 0, F.col("s_t") / F.col("c_t"))
                    .when(F.col("c_g") > 0, F.col("s_g") / F.col("c_g")))
    frac_arr = F.array(*[F.lit(float(f)) for f in fractions])
    hm = histogram_metrics(pred="pred")
    acc = scored.groupBy("outer_fold", "frac_idx", "topic").agg(hm["strict_acc"], hm["tolerant_acc"])
    return acc.select(
        (F.col("outer_fold") + 1).cast("int").alias("outer_fold"),
        F.element_at(frac_arr, F.col("frac_idx") + 1).alias("fraction"),
        "topic", "strict_acc", F.col("tolerant_acc").alias("flexible_acc"))


def learning_curve_agg(curve: DataFrame) -> DataFrame:
    """Mean and standard error (ddof=0) over outer folds per (fraction, topic)."""
    def sem(c):
        return F.stddev_pop(c) / F.sqrt(F.count(c).cast("double"))
    return curve.groupBy("fraction", "topic").agg(
        F.avg("strict_acc").alias("strict_acc"), F.avg("flexible_acc").alias("flexible_acc"),
        sem("strict_acc").alias("strict_sem"), sem("flexible_acc").alias("flexible_sem"))


# ------------------------------------------------------------------ batch map
def batch_map(df: DataFrame, load: Callable[[], object],
              predict: Callable[[object, pd.DataFrame], pd.DataFrame], schema,
              ) -> DataFrame:
    """Run a user model over a table in Arrow batches: ``load()`` once per task,
    ``predict(model, batch)`` per batch. The model never leaves the executors."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield predict(model, batch)
    return df.mapInPandas(run, schema)


# ------------------------------------------------------- Spark ML per fold
def _features(folded: DataFrame, text: str, num_features: int) -> DataFrame:
    from pyspark.ml.feature import HashingTF, RegexTokenizer
    from turnscore.operators.similarity import TOKEN_SPLIT
    tok = RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=TOKEN_SPLIT, gaps=True,
                         toLowercase=True, minTokenLength=1)
    tf = HashingTF(inputCol="_tokens", outputCol="tf", numFeatures=num_features)
    return tf.transform(tok.transform(folded)).drop("_tokens")


def _per_fold(fit_one, k: int, parallel: int) -> list:
    """Run ``fit_one(f)`` for every fold; with ``parallel`` > 1 the fits are
    submitted from a driver thread pool so their Spark jobs share the cluster."""
    if parallel <= 1:
        return [fit_one(f) for f in range(k)]
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=min(parallel, k)) as pool:
        return list(pool.map(fit_one, range(k)))


def text_regression_cv(folded: DataFrame, key: str = "example_id", text: str = "text",
                       label: str = "label", topic: str = "topic", k: int = S.N_FOLDS,
                       num_features: int = 1 << 14, reg_param: float = 0.1,
                       model_name: str = "text_linear", parallel: int = S.N_FOLDS,
                       models_path: str | None = None) -> DataFrame:
    """Out-of-fold predictions of a text regression with squared-error loss
    (ML2): tokens -> hashed term frequencies -> IDF fitted on the training
    folds only -> ridge LinearRegression. Features are computed once and
    written to the shared checkpoint folder (no cache to release, nothing to
    recompute after an executor loss); each fold is one distributed fit, saved as
    ``models_path``/fold=f (IDF and regression in one pipeline model) if a path is given.
    Output is the prediction table (ML8)."""
    from functools import reduce

    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import IDF
    from pyspark.ml.regression import LinearRegression

    from turnscore.session import materialize
    feats = materialize(_features(folded.select(key, "fold", topic, label, text), text, num_features)
                        .drop(text), "text-features")
    def fit_one(f: int) -> DataFrame:
        train = feats.where(F.col("fold") != f)
        val = feats.where(F.col("fold") == f)
        idf = IDF(inputCol="tf", outputCol="features").fit(train)
        lr = LinearRegression(featuresCol="features", labelCol=label, regParam=reg_param,
                              elasticNetParam=0.0, maxIter=50)
        model = lr.fit(idf.transform(train))
        if models_path:
            save_model(PipelineModel([idf, model]), f"{models_path}/fold={f}")
        return model.transform(idf.transform(val)).select(
            key, F.lit(model_name).alias("model"), F.col("fold").cast("int").alias("fold"),
            F.col(topic).alias("topic"), F.col(label).cast("int").alias("label"),
            F.col("prediction").alias("pred"))
    return reduce(lambda a, b: a.unionByName(b), _per_fold(fit_one, k, parallel))


def gbt_regression_cv(folded: DataFrame, key: str = "example_id", text: str = "text",
                      label: str = "label", topic: str = "topic", k: int = S.N_FOLDS,
                      num_features: int = 256, loss: str = "absolute", max_iter: int = 20,
                      validation_tol: float = 0.01, model_name: str = "text_gbt",
                      parallel: int = S.N_FOLDS, models_path: str | None = None) -> DataFrame:
    """Out-of-fold predictions of gradient-boosted trees (ML3 / ML4) with early
    stopping on the validation fold (``validationIndicatorCol``: the held-out
    fold is scored during boosting and boosting stops when it stops improving,
    as the study keeps the best epoch on its evaluation fold) and squared or
    absolute loss."""
    from functools import reduce

    from pyspark.ml.regression import GBTRegressor

    from turnscore.session import materialize
    feats = materialize(_features(folded.select(key, "fold", topic, label, text), text, num_features)
                        .drop(text), "gbt-features")
    def fit_one(f: int) -> DataFrame:
        data = feats.withColumn("is_val", F.col("fold") == f)
        gbt = GBTRegressor(featuresCol="tf", labelCol=label, lossType=loss, maxIter=max_iter, maxDepth=3,
                           validationIndicatorCol="is_val", validationTol=validation_tol, seed=S.SEED)
        model = gbt.fit(data)
        if models_path:
            save_model(model, f"{models_path}/fold={f}")
        return model.transform(feats.where(F.col("fold") == f)).select(
            key, F.lit(model_name).alias("model"), F.col("fold").cast("int").alias("fold"),
            F.col(topic).alias("topic"), F.col(label).cast("int").alias("label"),
            F.col("prediction").alias("pred"))
    return reduce(lambda a, b: a.unionByName(b), _per_fold(fit_one, k, parallel))

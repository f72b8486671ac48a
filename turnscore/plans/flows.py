"""End-to-end flows: each reads its input tables, runs the operators, and writes
its outputs, covering one step of the study (recordings ledger, transcript
cleaning, score distribution, example preparation, evaluation, learning curve,
model comparison, similarity). Paths are arguments; every step is a Spark job
(nothing is collected to the driver).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscore import schemas as S
from turnscore.operators import absolute as AB
from turnscore.operators import compare as CP
from turnscore.operators import confusion as CF
from turnscore.operators import curve as CU
from turnscore.operators import dialogue as DG
from turnscore.operators import metrics as M
from turnscore.operators import models as ML
from turnscore.operators import report as RP
from turnscore.operators import sampling as SA
from turnscore.operators import scores as SC
from turnscore.operators import similarity as SI
from turnscore.operators import turns as TU
from turnscore.session import materialize
from turnscore.sources import readers as R
from turnscore.sources import writers as W
from turnscore.streaming import ingest as IN


def register_recordings(spark: SparkSession, video_root: str, ledger_path: str, manifest_out: str) -> DataFrame:
    """Recordings not yet in the ledger (SC7, JO1): append them to the manifest
    table, then to the ledger (data first, so a failure never marks an
    unwritten subject as done). Returns the new manifest rows as written."""
    manifest = R.media_manifest(spark, video_root)
    new = materialize(IN.pending(manifest, R.read_ledger(spark, ledger_path)), "new-recordings")
    W.append_rows(new, manifest_out)
    W.append_rows(new.select("subject").distinct().withColumn("processed_at", F.current_timestamp()), ledger_path)
    return new


BINARY_FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"


def register_recordings_stream(spark: SparkSession, video_root: str, ledger_path: str, manifest_out: str,
                               checkpoint: str, folder_prefix: str = "MC_1", suffix: str = "_MADRS.mp4"):
    """Streaming form of ``register_recordings`` (SS1): a file-source stream over
    ``<video_root>/<folder_prefix>*/*<suffix>`` (contents never read), processed
    with ``trigger(availableNow=True)``; the ledgered ``foreachBatch`` writes new
    subjects to ``manifest_out/batch_id=N`` and then to the ledger. The
    checkpoint makes a rerun pick up only files that arrived since."""
    from turnscore.functions.text import subject_key
    stream = spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA) \
        .option("pathGlobFilter", f"*{suffix}").load(f"{video_root.rstrip('/')}/{folder_prefix}*/")
    rows = stream.select("path", "length", "modificationTime") \
        .withColumn("subject", subject_key(F.col("path")))
    q = IN.ingest_stream(rows, ledger_path, manifest_out, checkpoint)
    q.awaitTermination()
    return q


def clean_transcripts(spark: SparkSession, turns_path: str, out_path: str, fmt: str = "parquet",
                      order: str = "global") -> DataFrame:
    """Phrase replacement and merge of consecutive same-speaker turns (step 02)."""
    turns = R.read_turns(spark, turns_path, fmt=fmt, seq="seq" if fmt == "parquet" else None)
    merged = TU.merge_turns(turns, order=order)
    W.write_table(merged, out_path)
    return spark.read.parquet(out_path)


def map_texts(spark: SparkSession, in_path: str, out_path: str, load, predict, schema) -> DataFrame:
    """A user text model over a table in Arrow batches (ML5; e.g. a grammar
    corrector over merged turns): ``load()`` once per task, ``predict(model,
    pandas_batch) -> pandas_batch`` per batch, output ``schema`` declared."""
    out = ML.batch_map(spark.read.parquet(in_path), load, predict, schema)
    W.write_table(out, out_path)
    return spark.read.parquet(out_path)


def score_distribution(spark: SparkSession, scored_path: str, out_path: str) -> DataFrame:
    """First valid score per (topic, subject), real vs synthetic counts 0..6 per
    evaluated topic (step 03), written as CSV in display order."""
    hist = SC.histogram_real_synthetic(DG.first_score(R.read_scored_turns(spark, scored_path)),
                                       S.topic_dim(spark))
    W.write_table(hist, out_path, fmt="csv", sort_by=["rank", "score"])
    return hist


def prepare_examples(spark: SparkSession, scored_path: str, examples_out: str, histogram_out: str) -> DataFrame:
    """Dialogue examples with the first valid patient score (step 04): JSON lines
    ordered by subject and topic, plus the per-topic score histogram."""
    scored = R.read_scored_turns(spark, scored_path)
    W.write_examples(DG.build_examples(scored), examples_out, sort_by=["subject", "topic"])
    first = DG.first_score(scored, ["subject", "topic"], speaker=S.PATIENT_SPEAKER)
    W.write_table(SC.histogram_topic(first), histogram_out, fmt="csv", sort_by=["topic", "score"])
    return R.read_examples(spark, examples_out)


def _labelled_examples(spark: SparkSession, examples_path: str) -> DataFrame:
    """Examples with label, topic and a stable id: the line position in the
    JSON-lines files (identical examples stay distinct)."""
    ex = R.with_source_order(R.read_examples(spark, examples_path), "example_id")
    ex = DG.parse_examples(ex)
    bad = ex.where(F.col("label").isNull()).count()
    if bad:
        raise ValueError(f"{bad} examples have an output without a score")
    return ex.select("example_id", "input", F.col("parsed_topic").alias("topic"), "label")


def evaluate(spark: SparkSession, predictions: DataFrame, out_dir: str) -> None:
    """Everything the evaluation step writes for a prediction table (example_id,
    model, fold, topic, label, pred): fold metrics per topic and overall, the
    cross-fold summary with its text lines, predictions (row form), confusion
    documents and traces."""
    preds = materialize(predictions, "predictions")
    folds = M.evaluate_folds(preds, ["model"])
    W.write_table(folds, f"{out_dir}/fold_metrics")
    summary = M.cross_fold(folds, ["model", "topic"])
    W.write_table(summary, f"{out_dir}/cross_fold_summary")
    RP.fold_summary_lines(summary).orderBy("model", "topic", "line_no").select("model", F.col("line").alias("value")) \
        .write.mode("overwrite").partitionBy("model").text(f"{out_dir}/summary_lines")
    W.write_predictions(preds, f"{out_dir}/predictions")
    dense = CF.confusion(preds, S.topic_dim(spark))
    W.write_confusion_docs(CF.confusion_document(dense), f"{out_dir}/confusion_docs")
    W.write_table(CF.trace(dense), f"{out_dir}/confusion_trace")


def mean_baseline(spark: SparkSession, examples_path: str, out_dir: str) -> None:
    """Per-topic and overall in-sample mean-predictor baselines (AG7, AG8)."""
    ex = _labelled_examples(spark, examples_path)
    W.write_table(M.mean_baseline_topic(ex), f"{out_dir}/baseline_topic")
    W.write_table(M.mean_baseline_overall(ex), f"{out_dir}/baseline_overall")
    lines = RP.baseline_lines(spark.read.parquet(f"{out_dir}/baseline_topic"), spark.read.parquet(f"{out_dir}/baseline_overall"))
    W.write_lines(lines.orderBy("line_no"), f"{out_dir}/baseline_lines")


def cross_validate(spark: SparkSession, examples_path: str, out_dir: str, k: int = S.N_FOLDS,
                   model: str = "text_linear", features: int | None = None) -> DataFrame:
    """k-fold training and evaluation (step 05): text regression per fold
    (``model='text_linear'``), boosted trees with early stopping and absolute
    loss (``'text_gbt'``), a linear regression with absolute loss, its epochs kept and the
    best restored (``'text_absolute'``), or the out-of-fold topic mean (``'topic_mean'``). ``features``
    is the number of hashed text features; fitted models are kept per fold."""
    folded = materialize(SA.kfold(_labelled_examples(spark, examples_path), ["example_id"], k=k), "folds")
    if model == "topic_mean":
        preds = ML.topic_mean_cv_predictions(folded)
    elif model == "text_gbt":
        preds = ML.gbt_regression_cv(folded.withColumnRenamed("input", "text"), k=k, models_path=f"{out_dir}/models",
                                     **({"num_features": features} if features else {}))
    elif model == "text_absolute":
        preds = AB.text_absolute_cv(folded.withColumnRenamed("input", "text"), k=k, models_path=f"{out_dir}/models",
                                    **({"num_features": features} if features else {}))
    else:
        preds = ML.text_regression_cv(folded.withColumnRenamed("input", "text"), k=k, models_path=f"{out_dir}/models",
                                      **({"num_features": features} if features else {}))
    evaluate(spark, preds, out_dir)
    return spark.read.parquet(f"{out_dir}/fold_metrics")


def learning_curve(spark: SparkSession, examples_path: str, out_dir: str, model: str = "topic_mean",
                   features: int | None = None) -> DataFrame:
    """Nested-subset learning curve of the topic-mean predictor or, with ``model='text_linear'``, of a text
    regression (steps 06, 07): raw and aggregated CSV tables."""
    folded = materialize(SA.kfold(_labelled_examples(spark, examples_path), ["example_id"]), "folds")
    if model == "text_linear":
        curve = CU.learning_curve_text(folded, ["example_id"], text="input", **({"num_features": features} if features else {}))
    else:
        curve = ML.learning_curve_mean(folded, ["example_id"])
    curve = materialize(curve, "curve")
    W.write_table(curve, f"{out_dir}/results_by_fraction", fmt="csv", sort_by=["outer_fold", "fraction", "topic"])
    W.write_table(ML.learning_curve_agg(curve), f"{out_dir}/aggregated_results", fmt="csv",
                  sort_by=["fraction", "topic"])
    return R.read_learning_curve(spark, f"{out_dir}/results_by_fraction")


def compare_models(spark: SparkSession, base_docs: str, tuned_docs: str, out_dir: str,
                   spec=S.COMPARISONS) -> DataFrame:
    """Contingency tables, exact McNemar tests, Bonferroni correction and error
    reduction from two confusion documents (step 08); report lines are written
    one folder per comparison."""
    def trace_of(path, model):
        dense = R.read_confusion_doc(spark, path)
        return CF.trace(dense.withColumn("model", F.lit(model)))
    tr = materialize(trace_of(base_docs, "base").unionByName(trace_of(tuned_docs, "tuned")), "trace")
    td = S.topic_dim(spark)
    tests = CP.marginal_comparisons(tr, td, spec)
    errors = CP.error_reduction(tr, td, spec)
    W.write_table(tests, f"{out_dir}/comparisons")
    W.write_table(errors, f"{out_dir}/error_reduction")
    lines = RP.comparison_report(tests, errors)
    lines.orderBy("file_slug", "line_no").select("file_slug", F.col("line").alias("value")) \
        .write.mode("overwrite").partitionBy("file_slug").text(f"{out_dir}/reports")
    return spark.read.parquet(f"{out_dir}/comparisons")


def similarity_report(spark: SparkSession, real_path: str, synthetic_path: str, out_dir: str,
                      text: str = "text", score: str = "score", encoder=None) -> DataFrame:
    """Real vs synthetic text similarity (step 09): mean cosines overall and per score group (``similarity``).

    ``encoder`` is a user's encoder, as the path of a Python file or as a pair (load, encode), see
    ``similarity.encode_texts``; its vectors are written once. The most and the least similar texts
    follow with their ids and texts (``extremes``). Without an encoder, vectors are counts of words,
    and there are no extremes."""
    pairs = R.read_text_pairs(spark, real_path, synthetic_path, text=text, score=score) \
        .withColumn("id", F.monotonically_increasing_id())
    docs = materialize(pairs.select("id", F.col(text).alias("text"), F.col(score).cast("int").alias("score"), "synthetic"), "pairs")
    if encoder is None:
        w = materialize(SI.term_weights(docs, "id", "text", keep=["score", "synthetic"]), "terms")
        overall, per = SI.cosine_mean_terms(docs, w), SI.cosine_mean_terms(docs, w, by=["score"])
    else:
        load, encode = SI.file_encoder(spark, encoder) if isinstance(encoder, str) else encoder
        vectors = materialize(SI.encode_texts(docs, "text", load, encode, ["id", "score", "synthetic"]), "vectors")
        overall, per = SI.cosine_mean(vectors), SI.cosine_mean(vectors, by=["score"])
        W.write_table(similarity_extremes(vectors, docs), f"{out_dir}/extremes")
    out = per.unionByName(overall.withColumn("score", F.lit(None).cast("int")))
    W.write_table(out, f"{out_dir}/similarity")
    return spark.read.parquet(f"{out_dir}/similarity")


def similarity_extremes(vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """The most and the least similar pair: kind, cosine, real_id, synthetic_id and both texts."""
    ext = SI.cosine_extremes(vectors).select(F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}_cosine").alias("cosine"), F.col(f"{kind}_pair.real_id").alias("real_id"),
                 F.col(f"{kind}_pair.synthetic_id").alias("synthetic_id")) for kind in ("max", "min")])).alias("e")).select("e.*")
    def side(name):
        return docs.select(F.col("id").alias(f"{name}_id"), F.col("text").alias(f"{name}_text"))
    return ext.join(side("real"), "real_id", "left").join(side("synthetic"), "synthetic_id", "left") \
        .select("kind", "cosine", "real_id", "synthetic_id", "real_text", "synthetic_text")

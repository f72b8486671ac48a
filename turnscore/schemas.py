"""Table schemas and fixed dimension values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the study's values for identical results).
# Interview topics in display order: German key, English display label.
# "Allgemein" is a rubric topic that is never evaluated.
# ---------------------------------------------------------------------------
TOPICS = [
    ("Traurigkeit", "1) Reported sadness"),
    ("Anspannung", "2) Inner tension"),
    ("Schlaf", "3) Sleep disturbances"),
    ("Appetit", "4) Loss of appetite"),
    ("Konzentration", "5) Difficulties concentrating"),
    ("Antriebslosigkeit", "6) Lassitude"),
    ("Gefühlslosigkeit", "7) Emotional numbness"),
    ("Gedanken", "8) Pessimistic thoughts"),
    ("Suizid", "9) Suicidal ideations"),
]
GENERAL_TOPIC = "Allgemein"
UNKNOWN_TOPIC = "Unknown"
# Ordinal score range 0..6 and the tolerance of the "flexible" rule.
SCORE_MIN, SCORE_MAX = 0, 6
TOLERANCE = 1
# Phrases replaced, in this order, before consecutive turns are merged.
PHRASES = [("Vielen Dank", "mhm"), ("Amen", "mhm")]
# Speaker labels: the interviewer is SPEAKER_00, every other label is the patient.
INTERVIEWER_SPEAKER = "SPEAKER_00"
PATIENT_SPEAKER = "SPEAKER_01"
SYNTHETIC_SUFFIX = "_Syn"
# Learning-curve training fractions of the whole data set, number of folds, seed.
FRACTIONS = [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7, 0.8]
N_FOLDS = 5
SEED = 42
# Model comparisons: (display name, model and rule of side A, model and rule of
# side B). The study's 4th spec reads the same inputs as its 3rd; the corrected
# spec reads what the names say. Display names are neutral labels of our own.
COMPARISONS = [
    ("tuned-flexible vs. base-flexible", "base", "flexible", "tuned", "flexible"),
    ("tuned vs. base", "base", "strict", "tuned", "strict"),
    ("tuned-flexible vs. tuned", "base", "strict", "tuned", "flexible"),
    ("base-flexible vs. base", "base", "strict", "tuned", "flexible"),
]
COMPARISONS_CORRECTED = [
    ("tuned-flexible vs. base-flexible", "base", "flexible", "tuned", "flexible"),
    ("tuned vs. base", "base", "strict", "tuned", "strict"),
    ("tuned-flexible vs. tuned", "tuned", "strict", "tuned", "flexible"),
    ("base-flexible vs. base", "base", "strict", "base", "flexible"),
]
# Wording of the text reports: comparison head, its rule (name length + extra), topic,
# table, p-values, and the closing error analysis; baseline and per-topic headings.
REPORT = {
    "head": "McNemar's Test Results for ", "rule_extra": 26, "topic": "Topic: ", "table": "Contingency Table:",
    "p": "p-value: %.20f", "p_adj": "Corrected p-value: %.20f", "errors": "Overall Error Analysis for ",
    "errors_a": "Base Model Total Errors: ", "errors_b": "Fine-Tuned Model Total Errors: ",
    "reduction": "Error Reduction Percentage: %.2f%%", "samples": "Total Samples Across Topics: ",
    "baseline_head": "=== Baseline MSE and MAE Per Topic (Mean Predictor) ===",
    "baseline_topic": "%s: Mean Score=%.2f, MSE=%.4f, MAE=%.4f",
    "baseline_all": "=== Overall Baseline Results (All Topics Combined) ===",
    "mse": "Overall MSE: %.4f", "mae": "Overall MAE: %.4f", "std": "Std of Errors: %.4f",
    "metrics_topic": "Metrics for Topic: ", "metric": "  %s: mean=%.4f, std=%.4f",
}
# ---------------------------------------------------------------------------

TURNS = T.StructType([
    T.StructField("subject", T.StringType()),
    T.StructField("speaker", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("seq", T.LongType()),
])

SCORED_TURNS = T.StructType([
    T.StructField("subject", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("speaker", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("seq", T.LongType()),
])

EXAMPLES = T.StructType([
    T.StructField("input", T.StringType()),
    T.StructField("output", T.StringType()),
])

SEGMENTS = T.StructType([
    T.StructField("subject", T.StringType()),
    T.StructField("speaker", T.StringType()),
    T.StructField("start_s", T.DoubleType()),
    T.StructField("end_s", T.DoubleType()),
])

LEDGER = T.StructType([
    T.StructField("subject", T.StringType()),
    T.StructField("processed_at", T.TimestampType()),
    T.StructField("batch_id", T.LongType()),
])

LEARNING_CURVE = T.StructType([
    T.StructField("outer_fold", T.IntegerType()),
    T.StructField("fraction", T.DoubleType()),
    T.StructField("topic", T.StringType()),
    T.StructField("strict_acc", T.DoubleType()),
    T.StructField("flexible_acc", T.DoubleType()),
])

RUBRIC = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("description", T.StringType()),
    T.StructField("criterion", T.StringType()),
])

# Confusion document: topic -> {rule -> 7x7 counts}, row = true, column = predicted.
CONFUSION_DOC = T.MapType(
    T.StringType(), T.MapType(T.StringType(), T.ArrayType(T.ArrayType(T.LongType()))))


def topic_dim(spark: SparkSession) -> DataFrame:
    """Nine evaluated topics with display label and 1-based display rank."""
    rows = [(rank, key, label) for rank, (key, label) in enumerate(TOPICS, start=1)]
    return spark.createDataFrame(rows, "rank INT, topic STRING, label_en STRING")

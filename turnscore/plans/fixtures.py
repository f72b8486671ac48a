"""Fixture views over the driver tables, in Spark (DataFrame API) and as DuckDB SQL.

The study's inputs are private; these views give every operator an input whose
size grows with the given tables (see FIXTURES.md). Each Spark builder has a
SQL twin used by the oracle; both must define the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscore import schemas as S

# Topic of an event: event_id % 10 indexes this list (0 = the rubric-only topic).
TOPIC_BY_DIGIT = [S.GENERAL_TOPIC] + [t for t, _ in S.TOPICS]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _topic(event_id) -> F.Column:
    return F.element_at(F.array(*[F.lit(t) for t in TOPIC_BY_DIGIT]),
                        (event_id % 10 + 1).cast("int"))


def _speaker(event_type) -> F.Column:
    return F.when(event_type.isin("view", "click"), F.lit("SPEAKER_00")).otherwise(F.lit("SPEAKER_01"))


def _text(event_type, event_id, props) -> F.Column:
    return (F.when(event_type == "error", F.lit("Vielen Dank"))
            .when(event_type == "signup", F.lit(""))
            .when(event_type == "purchase", F.concat(F.lit("Amen "), props))
            .otherwise(F.concat(event_type, F.lit(" "), event_id.cast("string"))))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gapped ``seq``; no subject for every 53rd user."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.when(F.col("user_id") % 53 != 0, F.concat(F.lit("MC_"), F.col("user_id").cast("string"))).alias("subject"),
        _speaker(F.col("event_type")).alias("speaker"),
        _text(F.col("event_type"), F.col("event_id"), F.col("props")).alias("text"),
        (F.col("event_id") + 5 * F.floor(F.col("event_id") / 7)).alias("seq"))


def scored_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No subject for every 53rd user, no topic for every 47th event."""
    e = table(spark, sf_dir, "events")
    subject = F.concat(F.lit("MC_"), F.col("user_id").cast("string"),
                       F.when(F.col("user_id") % 3 == 0, F.lit("_Syn")).otherwise(F.lit("")))
    score = F.when(F.col("event_type") == "signup", F.lit(None).cast("double")) \
        .otherwise((F.floor("value").cast("bigint") % 7).cast("double"))
    return e.select(
        F.when(F.col("user_id") % 53 != 0, subject).alias("subject"),
        F.when(F.col("event_id") % 47 != 0, _topic(F.col("event_id"))).alias("topic"),
        _speaker(F.col("event_type")).alias("speaker"),
        _text(F.col("event_type"), F.col("event_id"), F.col("props")).alias("text"),
        score.alias("score"), F.col("event_id").alias("seq"))


def predictions_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per example with the two models' continuous predictions."""
    e = table(spark, sf_dir, "events")
    label = F.floor("value").cast("bigint") % 7
    return e.select(
        F.col("event_id").alias("example_id"), _topic(F.col("event_id")).alias("topic"),
        label.cast("int").alias("label"),
        (F.col("value") / F.lit(60.0) - F.lit(1.0)).alias("pred_base"),
        (label.cast("double")
         + ((F.col("event_id") * 37) % 501 - 250).cast("double") / F.lit(100.0)).alias("pred_tuned"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row form: (example_id, model, topic, label, pred) for models base and tuned."""
    w = predictions_wide(spark, sf_dir)
    both = F.explode(F.array(
        F.struct(F.lit("base").alias("model"), F.col("pred_base").alias("pred")),
        F.struct(F.lit("tuned").alias("model"), F.col("pred_tuned").alias("pred"))))
    return w.select("example_id", "topic", "label", both.alias("m")) \
        .select("example_id", F.col("m.model").alias("model"), "topic", "label",
                F.col("m.pred").alias("pred"))


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("emb"),
                    F.col("label").alias("score"),
                    (F.col("vec_id") % 2 == 1).alias("synthetic"))


def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as the real side, and as the synthetic side each of them mixed with itself moved by one
    dimension (cosine about 0.92)."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    moved = F.concat(F.slice("v", 2, F.size("v")), F.slice("v", 1, 1))
    e = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    copy = e.select((F.col("vec_id") * 2 + 1).alias("id"), F.zip_with("v", moved, lambda x, y: x * 0.85 + y * 0.35).alias("emb"), F.lit(True).alias("synthetic"))
    return e.select((F.col("vec_id") * 2).alias("id"), F.col("v").alias("emb"), F.lit(False).alias("synthetic")).unionByName(copy)


def clustered_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``text_pairs`` with each vector drawn to the axis of its score (odd scores to the negative side)."""
    axis, sign = F.floor(F.col("score") / 2), F.when(F.col("score") % 2 == 0, 4.0).otherwise(-4.0)
    pull = F.transform("emb", lambda x, i: x.cast("double") + F.when(i == axis, sign).otherwise(0.0))
    return text_pairs(spark, sf_dir).withColumn("emb", pull)


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("subject"),
        F.when(F.col("role") == "assistant", F.lit("SPEAKER_00")).otherwise(F.lit("SPEAKER_01"))
        .alias("speaker"),
        F.col("text"), F.col("turn").alias("seq"))


def regression_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    label = F.greatest(F.lit(0), F.least(F.lit(6), (F.floor(F.log(F.col("n_chars").cast("double")))
                                                     - 4).cast("int")))
    return d.select(F.col("doc_id").alias("example_id"), F.col("lang").alias("topic"),
                    F.col("text"), label.cast("int").alias("label"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recording paths built from document ids (one per document)."""
    d = table(spark, sf_dir, "documents")
    code = F.concat(F.lit("MC_1"), F.col("doc_id").cast("string"))
    path = F.concat(F.lit("Video/"), code, F.lit("/"), code, F.lit("_MADRS.mp4"))
    return d.select(F.col("doc_id"), path.alias("path"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects already processed: documents with doc_id % 3 = 0."""
    d = table(spark, sf_dir, "documents").where(F.col("doc_id") % 3 == 0)
    return d.select(F.concat(F.lit("MC_1"), F.col("doc_id").cast("string")).alias("subject"))


def _micros_of_day(ts) -> F.Column:
    sec = F.date_part(F.lit("SECOND"), ts)  # decimal seconds with microseconds
    return ((F.hour(ts) * 3600 + F.minute(ts) * 60).cast("bigint") * 1000000
            + (sec * 1000000).cast("bigint"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diarization-like segments: start = seconds of day of ts, length value/10 s."""
    e = table(spark, sf_dir, "events")
    start = _micros_of_day(F.col("ts")).cast("double") / F.lit(1e6)
    return e.select(F.col("event_id").alias("id"),
                    F.concat(F.lit("MC_"), F.col("user_id").cast("string")).alias("subject"),
                    _speaker(F.col("event_type")).alias("speaker"),
                    start.alias("start_s"), (start + F.col("value") / F.lit(10.0)).alias("end_s"))


# ---------------------------------------------------------------------------
# DuckDB twins (CTE bodies). Tables are the driver's pre-registered views.
# ---------------------------------------------------------------------------
_TOPIC_SQL = "(['" + "','".join(TOPIC_BY_DIGIT) + "'])[event_id % 10 + 1]"
_SPEAKER_SQL = "CASE WHEN event_type IN ('view','click') THEN 'SPEAKER_00' ELSE 'SPEAKER_01' END"
_TEXT_SQL = ("CASE event_type WHEN 'error' THEN 'Vielen Dank' WHEN 'signup' THEN '' "
             "WHEN 'purchase' THEN 'Amen ' || props "
             "ELSE event_type || ' ' || CAST(event_id AS VARCHAR) END")

SQL = {
    "turns": f"""SELECT CASE WHEN user_id % 53 <> 0 THEN 'MC_' || CAST(user_id AS VARCHAR) END AS subject, {_SPEAKER_SQL} AS speaker,
        {_TEXT_SQL} AS text, event_id + 5 * (event_id // 7) AS seq FROM events""",
    "dense_turns": """SELECT subject, speaker, text, row_number() OVER (ORDER BY seq) - 1 AS seq FROM turns""",
    "scored_turns": f"""SELECT CASE WHEN user_id % 53 <> 0 THEN 'MC_' || CAST(user_id AS VARCHAR)
            || CASE WHEN user_id % 3 = 0 THEN '_Syn' ELSE '' END END AS subject,
        CASE WHEN event_id % 47 <> 0 THEN {_TOPIC_SQL} END AS topic, {_SPEAKER_SQL} AS speaker, {_TEXT_SQL} AS text,
        CASE WHEN event_type = 'signup' THEN NULL
             ELSE CAST(CAST(floor(value) AS BIGINT) % 7 AS DOUBLE) END AS score,
        event_id AS seq FROM events""",
    "predictions_wide": f"""SELECT event_id AS example_id, {_TOPIC_SQL} AS topic,
        CAST(CAST(floor(value) AS BIGINT) % 7 AS INTEGER) AS label,
        value / 60e0 - 1e0 AS pred_base,
        CAST(CAST(floor(value) AS BIGINT) % 7 AS DOUBLE)
          + CAST((event_id * 37) % 501 - 250 AS DOUBLE) / 1e2 AS pred_tuned FROM events""",
    "predictions": """SELECT example_id, 'base' AS model, topic, label, pred_base AS pred FROM predictions_wide
        UNION ALL SELECT example_id, 'tuned' AS model, topic, label, pred_tuned AS pred FROM predictions_wide""",
    "text_pairs": """SELECT vec_id AS id, embedding AS emb, label AS score, (vec_id % 2 = 1) AS synthetic
        FROM embeddings""",
    "conversation_turns": """SELECT CAST(conv_id AS VARCHAR) AS subject,
        CASE WHEN role = 'assistant' THEN 'SPEAKER_00' ELSE 'SPEAKER_01' END AS speaker,
        text, turn AS seq FROM conversations""",
    "regression_docs": """SELECT doc_id AS example_id, lang AS topic, text,
        CAST(greatest(0, least(6, CAST(floor(ln(CAST(n_chars AS DOUBLE))) AS INTEGER) - 4)) AS INTEGER)
          AS label FROM documents""",
    "manifest": """SELECT doc_id, 'Video/MC_1' || CAST(doc_id AS VARCHAR) || '/MC_1' || CAST(doc_id AS VARCHAR)
        || '_MADRS.mp4' AS path FROM documents""",
    "ledger": """SELECT 'MC_1' || CAST(doc_id AS VARCHAR) AS subject FROM documents WHERE doc_id % 3 = 0""",
    "segments": f"""SELECT event_id AS id, 'MC_' || CAST(user_id AS VARCHAR) AS subject, {_SPEAKER_SQL} AS speaker,
        CAST(epoch_us(ts) % 86400000000 AS DOUBLE) / 1e6 AS start_s,
        CAST(epoch_us(ts) % 86400000000 AS DOUBLE) / 1e6 + value / 10e0 AS end_s FROM events""",
}

# Which fixture CTEs a fixture depends on (emitted in this order).
_DEPS = {"predictions": ["predictions_wide"], "dense_turns": ["turns"]}


def with_views(*names: str) -> str:
    """A ``WITH`` prefix defining the named fixture views (and their dependencies)."""
    ordered: list[str] = []
    for n in names:
        for d in _DEPS.get(n, []) + [n]:
            if d not in ordered:
                ordered.append(d)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in ordered) + "\n"

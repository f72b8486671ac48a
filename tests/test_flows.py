"""End-to-end flows on files written from the driver tables (sf0.001)."""

import os
import tempfile

from pyspark.sql import functions as F

from tests.conftest import SF001
from turnscore.plans import fixtures as X
from turnscore.plans import flows


def _dir():
    return tempfile.mkdtemp(prefix="turnscore-flow-")


def test_transcript_to_comparison_flows(spark):
    d = _dir()
    X.scored_turns(spark, SF001).write.parquet(f"{d}/scored")
    X.turns(spark, SF001).write.parquet(f"{d}/turns")
    merged = flows.clean_transcripts(spark, f"{d}/turns", f"{d}/merged")
    assert merged.count() > 0
    hist = flows.score_distribution(spark, f"{d}/scored", f"{d}/distribution")
    assert hist.count() == 63
    ex = flows.prepare_examples(spark, f"{d}/scored", f"{d}/examples", f"{d}/histogram")
    n_ex = ex.count()
    assert n_ex > 0
    flows.mean_baseline(spark, f"{d}/examples", f"{d}/baseline")
    assert spark.read.parquet(f"{d}/baseline/baseline_overall").first().n == n_ex
    fm = flows.cross_validate(spark, f"{d}/examples", f"{d}/cv_base", model="topic_mean")
    assert fm.where("topic = 'ALL'").count() == 5
    flows.cross_validate(spark, f"{d}/examples", f"{d}/cv_tuned", model="text_linear")
    preds = spark.read.parquet(f"{d}/cv_tuned/predictions")
    assert preds.count() == n_ex
    cmp = flows.compare_models(spark, f"{d}/cv_base/confusion_docs/model=topic_mean",
                               f"{d}/cv_tuned/confusion_docs/model=text_linear", f"{d}/compare")
    assert cmp.count() > 0 and cmp.where("p_adj < p_value").count() == 0
    reports = os.listdir(f"{d}/compare/reports")
    assert len([r for r in reports if r.startswith("file_slug=")]) == 4
    curve = flows.learning_curve(spark, f"{d}/examples", f"{d}/curve")
    assert curve.select("fraction").distinct().count() == 12


def test_similarity_and_register_flows(spark):
    d = _dir()
    docs = X.regression_docs(spark, SF001)
    docs.where(F.col("example_id") % 2 == 0).select("text", F.col("label").cast("double").alias("score")) \
        .write.parquet(f"{d}/real")
    docs.where(F.col("example_id") % 2 == 1).select("text", F.col("label").cast("double").alias("score")) \
        .write.parquet(f"{d}/syn")
    sim = flows.similarity_report(spark, f"{d}/real", f"{d}/syn", f"{d}/out")
    assert sim.where("score IS NULL").count() == 1
    # recordings: a folder tree with two subjects, one already in the ledger
    for code in ("MC_1001", "MC_1002"):
        os.makedirs(f"{d}/video/{code}")
        open(f"{d}/video/{code}/{code}_MADRS.mp4", "wb").write(b"x")
    spark.createDataFrame([("MC_1001",)], "subject STRING").withColumn("processed_at", F.current_timestamp()) \
        .write.parquet(f"{d}/ledger/batch_id=-1")
    new = flows.register_recordings(spark, f"{d}/video", f"{d}/ledger", f"{d}/manifest")
    assert [r.subject for r in new.collect()] == ["MC_1002"]
    again = flows.register_recordings(spark, f"{d}/video", f"{d}/ledger", f"{d}/manifest")
    assert again.count() == 0


def test_register_stream_and_text_map(spark):
    d = _dir()
    for code in ("MC_1001", "MC_1002"):
        os.makedirs(f"{d}/video/{code}")
        open(f"{d}/video/{code}/{code}_MADRS.mp4", "wb").write(b"x")
    os.makedirs(f"{d}/video/XX_9")
    open(f"{d}/video/XX_9/XX_9_MADRS.mp4", "wb").write(b"x")  # folder prefix filtered out
    args = (f"{d}/video", f"{d}/ledger", f"{d}/manifest", f"{d}/ckpt")
    flows.register_recordings_stream(spark, *args)
    assert sorted(r.subject for r in spark.read.parquet(f"{d}/ledger").collect()) == ["MC_1001", "MC_1002"]
    flows.register_recordings_stream(spark, *args)  # nothing new
    assert spark.read.parquet(f"{d}/manifest").count() == 2
    os.makedirs(f"{d}/video/MC_1003")
    open(f"{d}/video/MC_1003/MC_1003_MADRS.mp4", "wb").write(b"x")
    flows.register_recordings_stream(spark, *args)
    assert spark.read.parquet(f"{d}/manifest").select("subject").distinct().count() == 3

    # batch and stream share one ledger and one manifest, in either order
    for code in ("MC_1004", "MC_1005"):
        os.makedirs(f"{d}/video/{code}")
        open(f"{d}/video/{code}/{code}_MADRS.mp4", "wb").write(b"x")
        if code == "MC_1004":
            assert [r.subject for r in flows.register_recordings(spark, *args[:3]).collect()] == ["MC_1004"]
    flows.register_recordings_stream(spark, *args)
    assert flows.register_recordings(spark, *args[:3]).count() == 0
    for table in ("ledger", "manifest"):
        rows = spark.read.parquet(f"{d}/{table}").collect()
        assert sorted(r.subject for r in rows) == [f"MC_100{i}" for i in range(1, 6)]
        assert [r.batch_id for r in rows if r.subject == "MC_1004"] == [-1] and all(r.batch_id >= 0 for r in rows if r.subject != "MC_1004")

    X.turns(spark, SF001).write.parquet(f"{d}/turns")

    def load():
        return str.upper

    def predict(model, batch):
        return batch.assign(text=batch["text"].map(model))[["subject", "speaker", "text", "seq"]]
    out = flows.map_texts(spark, f"{d}/turns", f"{d}/upper", load, predict,
                          "subject STRING, speaker STRING, text STRING, seq LONG")
    assert out.count() == 1000 and out.where(F.col("text") != F.upper("text")).count() == 0

"""Ledgered streaming ingest (second run adds nothing, replay is idempotent),
source-order seq, readers and writers."""

import os
import tempfile

from pyspark.sql import functions as F

from turnscore.operators.turns import merge_turns
from turnscore.sources import readers as R
from turnscore.sources import writers as W
from turnscore.streaming import ingest as IN


def _scratch():
    return tempfile.mkdtemp(prefix="turnscore-test-")


def test_ingest_second_run_adds_nothing(spark):
    base = _scratch()
    src = f"{base}/src"
    spark.createDataFrame([(f"MC_1{i}", "SPEAKER_00", f"t{i}", i) for i in range(6)],
                          "subject STRING, speaker STRING, text STRING, seq LONG") \
        .write.parquet(f"{src}/part1")
    schema = spark.read.parquet(f"{src}/part1").schema
    ledger, sink, ckpt = f"{base}/ledger", f"{base}/data", f"{base}/ckpt"

    def run():
        s = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(src)
        IN.ingest_stream(s, ledger, sink, ckpt).awaitTermination()
    run()
    assert spark.read.parquet(ledger).select("subject").distinct().count() == 6
    run()  # same checkpoint, no new files
    assert spark.read.parquet(sink).count() == 6
    # new file with one new subject and one already processed
    spark.createDataFrame([("MC_10", "SPEAKER_01", "x", 7), ("MC_199", "SPEAKER_01", "y", 8)],
                          "subject STRING, speaker STRING, text STRING, seq LONG").write.parquet(f"{src}/part2")
    run()
    assert sorted(r.subject for r in spark.read.parquet(sink).where("seq >= 7").collect()) == ["MC_199"]


def test_batch_replay_is_idempotent(spark):
    base = _scratch()
    ledger, sink = f"{base}/ledger", f"{base}/data"
    batch = spark.createDataFrame([("A", 1), ("B", 2)], "subject STRING, seq LONG")
    fn = IN.ledger_batch_writer(ledger, sink)
    fn(batch, 0)
    fn(batch, 0)  # replay of batch 0 after a failure
    fn(batch, 1)  # later batch with already processed subjects
    assert spark.read.parquet(sink).count() == 2
    assert spark.read.parquet(ledger).select("subject").distinct().count() == 2


def test_merge_stream_touches_only_the_buckets_of_a_batch(spark):
    base = _scratch()
    schema = "subject STRING, speaker STRING, text STRING, seq LONG"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/src")
        stream = spark.readStream.schema(schema).parquet(f"{base}/src")
        IN.merge_stream(stream, f"{base}/turns", f"{base}/merged", f"{base}/ckpt", bucket_count=64).awaitTermination()
        return sorted((r.subject, r.text) for r in spark.read.parquet(f"{base}/merged").collect())

    def files():
        return {f for d, _, names in os.walk(f"{base}/merged") for f in names if f.startswith("part-")}
    assert arrive([("A", "0", "x", 0), ("A", "0", "y", 1), ("B", "1", "z", 0)]) == [("A", "x y"), ("B", "z")]
    before = files()
    assert arrive([("A", "0", "w", 2), ("C", "0", "c", 0)]) == [("A", "x y w"), ("B", "z"), ("C", "c")]
    assert len(before & files()) == 1  # the file of B


def test_ledger_of_batch_and_stream_is_one(spark):
    base = _scratch()
    fn = IN.ledger_batch_writer(f"{base}/ledger", f"{base}/data")
    fn(spark.createDataFrame([("A", 1)], "subject STRING, seq LONG"), 0)
    W.append_rows(spark.createDataFrame([("B",)], "subject STRING").withColumn("processed_at", F.current_timestamp()), f"{base}/ledger")
    fn(spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "subject STRING, seq LONG"), 1)
    assert sorted((r.subject, r.batch_id) for r in R.read_ledger(spark, f"{base}/ledger").collect()) == [("A", 0), ("B", -1), ("C", 1)]


def test_checkpoint_folder_must_be_shared_on_a_cluster(spark, monkeypatch):
    import pytest
    from turnscore import session

    class Cluster:
        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda key, default=None: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Cluster)


def test_release_deletes_the_files(spark):
    from turnscore.session import materialize, release
    df = materialize(spark.range(5), "gone")
    path = df._shared_path.replace("file:", "")
    assert df.count() == 5 and os.path.isdir(path)
    release(df)
    assert not os.path.exists(path)


def test_source_order_seq(spark):
    base = _scratch()
    os.makedirs(f"{base}/csv")
    with open(f"{base}/csv/a.csv", "w") as f:
        f.write("Subject Code,Speaker,Transcription\n")
        for i in range(50):
            f.write(f"S{i % 3},SPEAKER_0{i % 2},line {i}\n")
    df = R.read_turns(spark, f"{base}/csv", fmt="csv", seq=None)
    rows = sorted(df.collect(), key=lambda r: r.seq)
    assert [r.seq for r in rows] == list(range(50))
    assert [r.text for r in rows] == [f"line {i}" for i in range(50)]
    assert merge_turns(df).count() == 50


def test_examples_roundtrip_and_confusion_doc(spark):
    base = _scratch()
    ex = spark.createDataFrame([("Topic: Schlaf \nDialogue:\nPatient: Müde\n\n", "Score: 3.0")], "input STRING, output STRING")
    W.write_examples(ex, f"{base}/jsonl")
    raw = "".join(open(os.path.join(f"{base}/jsonl", p), encoding="utf-8").read()
                  for p in sorted(os.listdir(f"{base}/jsonl")) if p.endswith(".json"))
    assert "Müde" in raw and raw.index('"input"') < raw.index('"output"')
    assert R.read_examples(spark, f"{base}/jsonl").first().output == "Score: 3.0"
    doc = spark.createDataFrame([("m", '{"Schlaf": {"strict": [[1,0],[0,2]]}}')], "model STRING, doc STRING")
    W.write_confusion_docs(doc, f"{base}/docs")
    long = R.read_confusion_doc(spark, f"{base}/docs/model=m")
    assert sorted(tuple(r) for r in long.collect()) == [
        ("Schlaf", "strict", 0, 0, 1), ("Schlaf", "strict", 0, 1, 0),
        ("Schlaf", "strict", 1, 0, 0), ("Schlaf", "strict", 1, 1, 2)]


def test_media_manifest_prunes_content(spark):
    df = R.media_manifest(spark, "/root/testdata", folder_prefix="sf0.0", suffix="events.parquet")
    assert df.count() >= 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1].split("]")[0]


def test_ledger_missing_is_empty(spark):
    assert R.read_ledger(spark, f"{_scratch()}/nothing").count() == 0


def test_text_pairs_reader(spark):
    base = _scratch()
    spark.createDataFrame([("a", 1.0), (None, 2.0), ("c", float("nan"))], "text STRING, score DOUBLE") \
        .write.parquet(f"{base}/r")
    spark.createDataFrame([("x", 1.0)], "text STRING, score DOUBLE").write.parquet(f"{base}/s")
    df = R.read_text_pairs(spark, f"{base}/r", f"{base}/s")
    assert sorted((r.text, r.synthetic) for r in df.collect()) == [("a", False), ("x", True)]
    assert df.where(F.col("synthetic")).count() == 1


def test_source_order_seq_across_files(spark):
    base = _scratch()
    os.makedirs(f"{base}/csv")
    expected = []
    for f in range(3):
        with open(f"{base}/csv/part-{f:05d}.csv", "w") as fh:
            fh.write("Subject Code,Speaker,Transcription\n")
            for i in range(40 + 7 * f):
                fh.write(f"S{f},SPEAKER_00,file {f} line {i}\n")
                expected.append(f"file {f} line {i}")
    df = R.read_turns(spark, f"{base}/csv", fmt="csv", seq=None)
    rows = sorted(df.collect(), key=lambda r: r.seq)
    assert [r.seq for r in rows] == list(range(len(expected)))
    assert [r.text for r in rows] == expected


def test_source_order_seq_with_many_splits_per_file(spark):
    base = _scratch()
    os.makedirs(f"{base}/csv")
    expected = []
    for f in range(2):
        with open(f"{base}/csv/part-{f:05d}.csv", "w") as fh:
            fh.write("Subject Code,Speaker,Transcription\n")
            for i in range(300):
                fh.write(f"S{i % 4},SPEAKER_0{i % 2},file {f} line {i}\n")
                expected.append(f"file {f} line {i}")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    old_open = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = R.read_turns(spark, f"{base}/csv", fmt="csv", seq=None)
        assert df.rdd.getNumPartitions() > 4
        rows = sorted(df.collect(), key=lambda r: r.seq)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", old_open)
    assert [r.seq for r in rows] == list(range(len(expected)))
    assert [r.text for r in rows] == expected


def test_segments_and_rubric_readers(spark):
    from turnscore.operators import scores as SC
    from turnscore.operators import turns as TU
    base = _scratch()
    spark.createDataFrame([("MC_1", "SPEAKER_00", 1.2345, 2.5)], "subject STRING, speaker STRING, start_s DOUBLE, "
                          "end_s DOUBLE").write.parquet(f"{base}/seg")
    seg = TU.segments_ms(R.read_segments(spark, f"{base}/seg")).first()
    assert (seg.start_ms, seg.end_ms, seg.segment_key) == (1234, 2500, "MC_1_SPEAKER_00_1234_2500.wav")
    with open(f"{base}/rubric.json", "w", encoding="utf-8") as fh:
        fh.write('{"topic": "Schlaf", "score": 2, "description": "d", "criterion": "c"}\n')
    scores = spark.createDataFrame([("Schlaf", 2), ("Schlaf", 3)], "topic STRING, score INT")
    got = sorted((r.score, r.criterion) for r in SC.rubric_lookup(scores, R.read_rubric(spark, f"{base}/rubric.json"))
                 .collect())
    assert got == [(2, "c"), (3, None)]

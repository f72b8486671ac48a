"""Run merging and dialogue assembly on hand-written rows, with tiny seq buckets so
every bucket-border case is exercised."""

import random

from collections import Counter

import pytest
from pyspark.sql import functions as F

from turnscore.operators import dialogue as DG
from turnscore.operators import turns as TU

SCHEMA = "subject STRING, speaker STRING, text STRING, seq BIGINT"


def merged_rows(df):
    return [(r.subject, r.speaker, r.text) for r in df.orderBy("first_seq").collect()]


@pytest.mark.parametrize("cases", [
    ([("A", "0", "x", 0), ("A", "0", "y", 1), ("A", "1", "z", 2), ("A", "0", "w", 3)],
     [("A", "0", "x y"), ("A", "1", "z"), ("A", "0", "w")]),
    ([("A", "0", "", 0), ("A", "0", "y", 1)], [("A", "0", " y")]),
    ([("A", "0", "x", 0), ("A", "0", None, 1), ("A", "0", "y", 2)], [("A", "0", "x y")]),
    ([("A", "0", "x", 0), ("B", "0", "y", 1), ("A", "0", "z", 2)],
     [("A", "0", "x"), ("B", "0", "y"), ("A", "0", "z")]),
    ([("A", "0", "Vielen Dank Amendment", 0)], [("A", "0", "mhm mhmdment")]),
])
@pytest.mark.parametrize("bucket_rows", [1, 2, 1 << 16])
def test_merge_contract(spark, cases, bucket_rows):
    rows, expected = cases
    df = spark.createDataFrame(rows, SCHEMA)
    assert merged_rows(TU.merge_turns(df, bucket_rows=bucket_rows)) == expected


@pytest.mark.parametrize("bucket_rows", [1, 3, 7, 50])
def test_merge_does_not_depend_on_buckets_or_gaps(spark, bucket_rows):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        subj = rng.choice(["A", "B", None]) if rng.random() < 0.05 else rng.choice(["A", "A", "A", "B"])
        spk = rng.choice(["SPEAKER_00", "SPEAKER_01"]) if rng.random() < 0.4 else "SPEAKER_00"
        rows.append((subj, spk, rng.choice(["", None, "Amen", "hallo", "ja", "Vielen Dank"]), i))
    one = merged_rows(TU.merge_turns(spark.createDataFrame(rows, SCHEMA)))
    sparse = [(a, b, c, i * 1_000_003 + (i % 5) ** 7) for a, b, c, i in rows]
    assert merged_rows(TU.merge_turns(spark.createDataFrame(rows, SCHEMA).repartition(5), bucket_rows=bucket_rows)) == one
    assert merged_rows(TU.merge_turns(spark.createDataFrame(sparse, SCHEMA).repartition(5), bucket_rows=bucket_rows)) == one


def test_gaps_in_seq_do_not_break_runs(spark):
    df = spark.createDataFrame([("A", "0", "x", 0), ("A", "0", "y", 2), ("A", "0", "z", 5_000_000)], SCHEMA)
    assert merged_rows(TU.merge_turns(df)) == [("A", "0", "x y z")]


def test_a_sparse_seq_has_full_buckets(spark):
    from turnscore.operators.ordered import bucket_of, bucket_width
    df = spark.range(10_000).select((F.col("id") * 86_400_000).alias("seq"))
    n = df.select(bucket_of("seq", bucket_width(df, "seq", 100)).alias("b")).distinct().count()
    assert 95 <= n <= 105


def test_null_keys_belong_to_no_group(spark):
    rows = [("S", "T", "SPEAKER_01", "a", 2.0, 0), (None, "T", "SPEAKER_01", "b", 3.0, 1), ("S", None, "SPEAKER_01", "c", 4.0, 2)]
    df = spark.createDataFrame(rows, "subject STRING, topic STRING, speaker STRING, text STRING, score DOUBLE, seq BIGINT")
    assert [(r.subject, r.topic) for r in DG.dialogues(df).collect()] == [("S", "T")]
    assert [(r.topic, r.subject, r.score) for r in DG.first_score(df).collect()] == [("T", "S", 2)]


@pytest.mark.parametrize("bucket_rows", [1, 2, 100])
def test_dialogue(spark, bucket_rows):
    rows = [("S", "T", "SPEAKER_00", "Wie geht es?", None, 5),
            ("S", "T", "SPEAKER_01", "gut", 3.0, 7),
            ("S", "T", "SPEAKER_00", "und?", 1.0, 6),
            ("S", "T", "SPEAKER_01", None, 5.0, 9),
            ("S", "U", "SPEAKER_00", "x", 2.0, 1)]
    df = spark.createDataFrame(rows, "subject STRING, topic STRING, speaker STRING, text STRING, "
                                     "score DOUBLE, seq BIGINT")
    d = {(r.subject, r.topic): r for r in DG.dialogues(df, bucket_rows=bucket_rows).collect()}
    assert d[("S", "T")].dialogue == "Interviewer: Wie geht es?\nInterviewer: und?\nPatient: gut\nPatient: "
    assert d[("S", "T")].first_score_any == 1.0
    assert d[("S", "T")].first_score_patient == 3.0
    assert d[("S", "U")].first_score_patient is None
    ex = DG.build_examples(df, bucket_rows=bucket_rows).collect()
    assert len(ex) == 1
    assert ex[0].input == ("Topic: T \nDialogue:\nInterviewer: Wie geht es?\nInterviewer: und?\n"
                           "Patient: gut\nPatient:\n\n")
    assert ex[0].output == "Score: 3.0"


def test_example_text_contract(spark):
    df = spark.createDataFrame([("S", "Schlaf", "SPEAKER_01", "gut", 2.0, 0)],
                               "subject STRING, topic STRING, speaker STRING, text STRING, score DOUBLE, seq BIGINT")
    ex = DG.build_examples(df).collect()[0]
    assert ex.input == "Topic: Schlaf \nDialogue:\nPatient: gut\n\n"
    assert ex.output == "Score: 2.0"
    parsed = DG.parse_examples(DG.build_examples(df)).collect()[0]
    assert parsed.label == 2 and parsed.parsed_topic == "Schlaf"


def test_first_score_contract(spark):
    rows = [("S", "T", "SPEAKER_01", "a", None, 0), ("S", "T", "SPEAKER_00", "b", 3.0, 1),
            ("S", "T", "SPEAKER_01", "c", 5.0, 2), ("S", "T", "SPEAKER_01", "d", float("nan"), 3)]
    df = spark.createDataFrame(rows, "subject STRING, topic STRING, speaker STRING, text STRING, "
                                     "score DOUBLE, seq BIGINT")
    assert DG.first_score(df).collect()[0].score == 3
    assert DG.first_score(df, speaker="SPEAKER_01").collect()[0].score == 5


def test_merge_plan_has_no_unpartitioned_data_window(spark):
    df = spark.range(1000).select(F.lit("A").alias("subject"), F.lit("SPEAKER_00").alias("speaker"),
                                  F.lit("t").alias("text"), F.col("id").alias("seq"))
    plan = TU.merge_turns(df, bucket_rows=100)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan
    assert "CartesianProduct" not in plan


@pytest.mark.parametrize("bucket_rows", [1, 100])
def test_merge_by_subject_null_subject_rows_stay_apart(spark, bucket_rows):
    rows = [(None, "0", "a", 0), (None, "0", "b", 1), ("A", "0", "c", 0), ("A", "0", "d", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.subject or "", r.text) for r in TU.merge_turns(df, order="subject", bucket_rows=bucket_rows).collect())
    assert got == [("", "a"), ("", "b"), ("A", "c d")]


@pytest.mark.parametrize("longest", [900, 86_400_000])
def test_align_segments_matches_brute_force(spark, longest):
    """Also with one interval of a day among tiny ones, on either side."""
    rng = random.Random(3)
    segs, turns = [], []
    for i in range(150):
        subj = rng.choice(["A", "B", "C"])
        a = rng.randrange(0, 5000)
        segs.append((i, subj, a, a + rng.choice([1, 2, 5, 40, 400])))
        b = rng.randrange(0, 5000)
        turns.append((i, subj, b, b + rng.choice([1, 3, 30, 900])))
    segs.append((150, "A", 0, longest)), turns.append((150, "B", 1, longest)), turns.append((151, "A", 3, 3))
    schema = "id LONG, subject STRING, start_ms LONG, end_ms LONG"
    got = TU.align_segments(spark.createDataFrame(turns, schema), spark.createDataFrame(segs, schema))
    got = sorted((r.t_id, r.s_id, r.overlap_ms) for r in got.collect())
    exp = sorted((t[0], s[0], min(t[3], s[3]) - max(t[2], s[2])) for t in turns for s in segs
                 if t[1] == s[1] and max(t[2], s[2]) < min(t[3], s[3]))
    assert got == exp


def test_hot_subject_is_split_across_buckets(spark):
    """One subject holds a third of all rows: the data shuffles of the run merge
    and the dialogue assembly are keyed by (group, seq bucket), so the hot
    subject is spread over many tasks instead of one."""
    n = 3000
    rows = [("HOT" if i % 3 == 0 else f"S{i % 50}", f"SPEAKER_0{(i // 7) % 2}", f"t{i}", i) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    merged = TU.merge_turns(df, order="subject", bucket_rows=64)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    import re
    assert re.search(r"hashpartitioning\(subject#\d+, _b#\d+L?, \d+\)", plan)
    from turnscore.operators.ordered import bucket_of
    hot_buckets = df.where("subject = 'HOT'").select(bucket_of("seq", 64).alias("b")).distinct().count()
    assert hot_buckets >= (n // 64) - 1
    scored = df.withColumn("topic", F.lit("T")).withColumn("score", F.lit(None).cast("double"))
    dplan = DG.dialogues(scored, bucket_rows=64)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(subject#\d+, [^,]+, _b#\d+L?, \d+\)", dplan)
    assert sum(r.n_turns for r in merged.collect()) == n


@pytest.mark.parametrize("outliers", [[], [10**15], [-10**12, 10**12, 10**12 + 1]])
def test_buckets_follow_counts(spark, outliers):
    from turnscore.operators.ordered import bucket_of, bucket_width
    seqs = [*range(1, 6001), *range(10**6, 10**6 + 4000 * 50, 50), *outliers]
    df = spark.createDataFrame([(x,) for x in seqs], "seq long").repartition(4)
    rows = df.withColumn("b", bucket_of("seq", bucket_width(df, "seq", 100))).orderBy("seq").collect()
    assert all(x.b <= y.b for x, y in zip(rows, rows[1:]))
    sizes = Counter(r.b for r in rows)
    assert max(sizes.values()) <= 200 and len(sizes) >= 75

import numpy as np
import pytest

from turnscore.llm import toxicity
from turnscore.llm.queries import op2_toxicity

SF = "/root/testdata/sf0.1"


def test_fit_recovers_ordered_thresholds():
    r = np.random.default_rng(0)
    w = {1: 3.0, 2: 1.5, 3: -1.0}
    rows, grade = [], []
    for _ in range(6000):
        words = [k for k in range(1, 40) if r.random() < 0.3]
        s = sum(w.get(k, 0) for k in words) + r.logistic()
        rows.append(np.array(words, np.uint64))
        grade.append((s > 1.0) + (s > 3.0))
    m = toxicity.fit_ordinal(rows, np.array(grade), penalty=1e-3, steps=600)
    got = dict(zip(m.words.tolist(), m.total[:, 0]))
    assert got[1] == pytest.approx(3, abs=0.4) and got[2] == pytest.approx(1.5, abs=0.3) and got[3] == pytest.approx(-1, abs=0.3)
    assert max(abs(v) for k, v in got.items() if k > 3) < 0.15
    assert m.thresholds[0] == pytest.approx(1, abs=0.35) and m.thresholds[1] == pytest.approx(3, abs=0.5)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    model = toxicity.fit(docs, train)
    rows = toxicity.score(docs, model).withColumnRenamed("toxic", "flag").join(test, "doc_id").collect()
    right = np.mean([r.flag == bool(r.toxic) for r in rows])
    # about one toxic label in fifteen stands at a text without any offending word
    assert right > 0.985
    assert np.mean([r.flag for r in rows if r.toxic]) > 0.88
    assert np.mean([r.flag for r in rows if not r.toxic]) < 0.005
    assert all(0 <= r.expected_severity <= 2 and r.grade in (0, 1, 2) for r in rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, f"you idiot moron scum {i}" if i % 2 else f"what a fine day {i}") for i in range(60)] +
                                 [(None, None), (60, ""), (60, ""), (61, "idiot " * 30000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(50)] + [(None, 1, 0), (7, None, 0), (7, 1, 0)],
                                   "doc_id long, toxic int, text int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 64 and len([r for r in rows if r.doc_id == 60]) == 2
    assert {r.doc_id for r in rows if r.toxic} == {i for i in range(60) if i % 2} | {61}
    wide = docs.selectExpr("text AS toxic", "text", "doc_id")
    kept = toxicity.drop_toxic(wide, model)
    assert kept.columns == wide.columns and kept.count() == 33
    assert toxicity.score(docs.limit(0), model).collect() == []
    none = toxicity.fit(docs, labels.limit(0))
    assert {(r.toxic, r.expected_severity) for r in toxicity.score(docs, none).collect()} == {(False, 0.0)}


def test_query_scores_every_row(spark):
    df = op2_toxicity(spark, "/root/testdata/sf0.001")
    assert df.count() == 200


def test_rows_of_one_task_are_bounded(spark):
    """One labelled id holds many rows, equal and distinct ones."""
    rows = [(0, f"you idiot {i % 40}") for i in range(400)] + [(i, f"a fine day {i}" if i % 2 else "you scum") for i in range(1, 9)]
    docs = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, th string")
    chosen = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(9)], "lid long, toxic int")
    got = [tuple(r) for r in toxicity.sample_rows(docs, chosen, "doc_id", "text", 100).collect()]
    assert sorted(got) == sorted({(str(i) if i % 2 else "2" if t == "you scum" else "0", t, int(i % 2 == 0)) for i, t in rows})
    few = toxicity.sample_rows(docs, chosen, "doc_id", "text", 3).collect()
    assert sorted(r.toxic for r in few) == [0] * 4 + [1] * 6
    labels = chosen.withColumnRenamed("lid", "doc_id")
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs.distinct(), labels)
    assert a.words.tolist() == b.words.tolist() and np.array_equal(a.total, b.total) and len(a.words)

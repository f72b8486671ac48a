"""Every stage against a brute-force version, on what the stages before it kept."""

from pyspark.sql import functions as F

import corpus_pipeline as P
import __spark_entry__ as E
from turnscore.llm import toxicity as tox
from turnscore.llm.line_dedup import MIN_CHARS, MIN_LINES

from tests.llm import test_decontamination, test_line_dedup, test_ngram_join, test_packing

SF = "/root/testdata/sf0.001"


def test_registered():
    assert E.queries()["pipeline"] is P.run and "pipeline" not in E.oracle_sql()


def test_stages(spark, tmp_path):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.dtypes == first.dtypes
        out.write.parquet(str(tmp_path / name))
        seen[name] = docs, (docs := spark.read.parquet(str(tmp_path / name)))
    rows = {k: [{r.doc_id: r.text for r in d.collect()} if "text" in d.columns else d.collect() for d in v] for k, v in seen.items()}

    before, after = rows["toxicity"]
    model = tox.fit(first, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in tox.score(first, model).where("toxic").collect()}
    assert bad and after == {d: t for d, t in before.items() if d not in bad}

    before, after = rows["line_dedup"]
    assert after == test_line_dedup.brute(sorted(before.items()), MIN_LINES, MIN_CHARS) != before

    before, after = rows["ngram_join"]
    groups = test_ngram_join.brute(sorted(before.items()), 5, 80, 100)
    assert after == {d: before[d] for d, _, g in groups if d == g} and len(after) < len(before)

    before, after = rows["decontamination"]
    items = [(i.item_id, i.text) for i in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = {w for _, t in items for w in test_decontamination.words(t)}
    likely = {d: t for d, t in before.items() if sum(w in index for w in test_decontamination.words(t)) >= 11}
    small = {d: " ".join(test_decontamination.words(t)) for d, t in likely.items()}
    grams = {tuple(u[k:k + 4]) for _, t in items for u in [test_decontamination.words(t)] for k in range(len(u) - 3)}
    # a stretch of 13 words with two replaced holds four consecutive equal ones
    small = {d: t for d, t in small.items() for u in [t.split()] if any(tuple(u[k:k + 4]) in grams for k in range(len(u) - 3))}
    bad = {k[0] for k in test_decontamination.brute(sorted(small.items()), items)}
    assert bad and after == {d: t for d, t in before.items() if d not in bad}

    before, after = rows["packing"]
    test_packing.check(after, before, 2048)


def test_whole_run_survives_empty_input(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []


def test_odd_rows_and_columns_through_the_chain(spark, tmp_path):
    first = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame(
        [(None, "only a null id here", "en", "s", 5), (900001, None, None, None, None), (900002, "", "en", None, 0), (900003, "one word", None, "s", 8),
         (900003, "another text of this id", "de", "s", 3), (900004, "same row twice", "en", "s", 4), (900004, "same row twice", "en", "s", 4),
         (900005, "ö" * 200_000, "de", "s", 200_000)], first.schema)
    docs = first.unionByName(odd)
    for c in ("_ld_th", "_bm_bits", "_leak_id", "_nj_th", "th", "id"):
        docs = docs.withColumn(c, F.lit(7))
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    got = sorted([(r.doc_id, r.text) for r in docs.where("doc_id is null or doc_id > 900000").collect()], key=repr)
    assert got == sorted([(None, "only a null id here"), (900001, None), (900002, ""), (900003, "one word"), (900003, "another text of this id"),
                          (900004, "same row twice"), (900005, "ö" * 200_000)], key=repr)
    packed = P.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.select("doc_id").collect()}

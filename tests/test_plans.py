"""Plan checks over every registered query: no cartesian or nested-loop
joins, no row-at-a-time Python UDF, Arrow-batched Python only where intended,
filters and column pruning reach the scans; and results that do not depend on
the number of shuffle partitions."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF001
from turnscore.plans.registry import REGISTRY

PYTHON_ALLOWED = {"batch_map_tokens", "cosine_extremes", "cosine_extremes_work", "near_pairs", "near_pairs_hashed", "learning_curve_text",
                  "encoded_similarity"}
SKIP = {"text_regression_cv", "gbt_regression_cv", "text_absolute_cv"}  # Spark ML internals


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in REGISTRY if n not in SKIP])
def test_plan_shape(spark, name):
    p = _plan(E.queries()[name](spark, SF001))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p
    if name not in PYTHON_ALLOWED:
        assert "ArrowEvalPython" not in p and "MapInPandas" not in p and "PythonUDF" not in p


@pytest.mark.parametrize("name", ["confusion_matrices", "confusion_trace", "model_comparisons", "error_reduction"])
def test_predictions_are_scanned_once(spark, name):
    assert _plan(E.queries()[name](spark, SF001)).count("FileScan parquet") == 1


def test_text_is_not_shuffled_for_cosines(spark):
    df = E.queries()["text_cosine_by_score"](spark, SF001)
    for line in _plan(df).splitlines():
        if "Exchange hashpartitioning" in line:
            assert "text#" not in line and "_t#" not in line


def test_scan_prunes_columns(spark):
    p = _plan(E.queries()["eval_by_topic"](spark, SF001))
    # the events scan reads only the columns the predictions need
    assert "ReadSchema: struct<event_id:bigint,value:double>" in p


@pytest.mark.parametrize("name", ["merge_turns", "eval_by_fold_topic", "dialogue_examples", "confusion_matrices",
                                  "learning_curve_mean"])
def test_partition_count_invariance(spark, name):
    results = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 13):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            rows = E.queries()[name](spark, SF001).collect()
            results.append(sorted((tuple(r) for r in rows), key=repr))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] == results[2]

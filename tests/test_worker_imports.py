"""Queries that run Python on the executors must not need this package there:
run them from a foreign working directory in a fresh process (as the driver of
the correctness check does) and check they complete."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
for name in ("cosine_extremes", "near_pairs", "batch_map_tokens"):
    print(name, E.queries()[name](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_python_worker_queries_run_outside_the_repo():
    cwd = tempfile.mkdtemp(prefix="turnscore-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True,
                         timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "batch_map_tokens 200" in out.stdout

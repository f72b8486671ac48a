"""Executors need no copy of this package: a fresh process in a folder of its own runs every query with workers that cannot import it."""

import os
import subprocess
import sys

from tests.conftest import ROOT, SF001

CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from turnscore.session import build_session
spark = build_session("local[4]", 4, extra={"spark.driver.memory": "3g"})
import __spark_entry__ as E
from pyspark.sql import functions as F

def blocked(batches):
    import importlib.util
    assert importlib.util.find_spec("turnscore") is None
    yield from batches

spark.range(4).mapInArrow(blocked, "id long").collect()
for name, q in E.queries().items():
    if name == "pipeline" or name.startswith("op"):
        print(name, q(spark, sys.argv[2]).count())
"""


def test_queries_run_from_a_foreign_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE, ROOT, SF001], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-3000:]
    assert len(out.stdout.split("\n")) >= 14

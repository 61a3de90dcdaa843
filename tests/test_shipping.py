"""Python tasks find the library although the program starts in another folder."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", sys.argv[1]).getOrCreate())
import __spark_entry__ as entry
print("ROWS", entry.queries()["dp_forest_leaf_counts"](spark, "/root/testdata/sf0.001").count())
"""


def test_started_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", PROGRAM, f"{tmp_path}/shared"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 1600" in run.stdout, run.stderr[-2000:]

"""The driver calls the entry points from its own working directory and its
own session: Python tasks must still import the package (shipped with
addPyFile), and the local checkpoint folder must be created on demand."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4") \\
    .config("spark.ui.enabled", "false").getOrCreate()
from __spark_entry__ import entry, queries
assert entry(spark).count() == 1
qs = queries()
for key in ("encode_udf", "sample_n", "failure_capture"):
    assert qs[key](spark, "/root/testdata/sf0.001").count() > 0, key
print("OK")
"""


def test_entry_points_from_another_directory():
    with tempfile.TemporaryDirectory() as cwd:
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True,
                             text=True, timeout=600)
    assert out.returncode == 0 and "OK" in out.stdout, out.stderr[-3000:]

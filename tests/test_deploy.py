import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
q = e.queries()
print("ROWS", q["roc_curve"](spark, "/root/testdata/sf0.001").count(), e.entry(spark).count())
"""


def test_queries_run_from_a_foreign_working_directory():
    """Python-worker plans (mapInPandas) must not depend on the driver's cwd."""
    cwd = tempfile.mkdtemp(prefix="balsam-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True,
                       timeout=600)
    assert r.returncode == 0, r.stderr[-2000:]
    line = [x for x in r.stdout.splitlines() if x.startswith("ROWS")][0]
    assert int(line.split()[1]) > 0 and int(line.split()[2]) == 1

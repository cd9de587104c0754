"""The queries run wherever the driver was started."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
sys.path.remove({repo!r})
named = e.queries()
print("ROWS", e.entry(spark).count(), *(named[n](spark, "/root/testdata/sf0.001").count() for n in ("j10_cosine_neighbors", "st16_ols")))
"""


def test_workers_get_the_library_in_any_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=REPO)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    rows = done.stdout.split("ROWS")[-1].split()
    assert len(rows) == 3 and all(int(n) > 0 for n in rows), done.stderr[-2000:]

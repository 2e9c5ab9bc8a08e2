"""Executors that have only Spark, the usual libraries and what a job brings along."""

import os
import subprocess
import sys

from helpers import SF

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (
    SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "4").getOrCreate()
)
import __spark_entry__ as entry

def seen(batches):
    import importlib.util
    import pyarrow as pa
    for _ in batches:
        yield pa.RecordBatch.from_pylist([{{"there": importlib.util.find_spec("postloom") is not None}}])

assert not spark.range(1).mapInArrow(seen, "there boolean").first()[0]
for name in {names!r}:
    assert entry.queries()[name](spark, {sf!r}).count() > 0, name
print("all ran")
"""


def test_queries_run_where_the_package_is_not_installed(tmp_path):
    names = ["op2_decontaminate", "op3_bpe", "op6_langid", "op11_substring_dedup", "op12_align", "op13_periodic_runs"]
    script = SCRIPT.format(repo=REPO, names=names, sf=SF)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "all ran" in done.stdout, done.stderr[-3000:]

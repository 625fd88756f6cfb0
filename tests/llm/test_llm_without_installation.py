"""All queries run where the workers can't import this package, as on a cluster without it."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"

CODE = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from pyspark.sql import SparkSession
conf = {"spark.master": "local[2]", "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
seen = spark.range(1).rdd.map(lambda _: __import__("importlib.util").util.find_spec("pregonero") is not None).first()
assert not seen, "the workers can import the package, so this test shows nothing"
for name in ("op5_language_id", "op6_lm_scoring", "u1_insert_two_unique_keys"):
    assert entry.queries()[name](spark, sys.argv[2]).count() > 0
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_models_reach_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", CODE, ROOT, SF], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]

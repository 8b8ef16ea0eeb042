"""Queries in a session that someone else made, with Spark's defaults, from
another folder and without the package on the workers' path."""
import os
import subprocess
import sys

from conftest import SF001

import qaspark

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(qaspark.__file__)))


#: Queries with Python tasks or frames made by the driver, one of each kind.
NAMES = ["cca_one_stage", "cca_two_stage", "cca_one_stage_product", "roundtrip_model", "sparse_two_stage_product",
         "qa_cosine", "cluster_topk", "assign_centroid", "kmeans_groups", "holographic_nested", "text_tokenize"]


def test_queries_in_a_bare_session(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
bad, q = [], e.queries()
for name in {NAMES!r}:
    try:
        q[name](spark, {SF001!r}).write.format("noop").mode("overwrite").save()
    except Exception as x:
        bad.append((name, str(x)[:200]))
assert not bad, bad
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env, timeout=900)

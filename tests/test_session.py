import os
import subprocess
import sys

import pytest

from bytesieve import session
from bytesieve.operators import evaluation as ev
from bytesieve.operators import triage

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_a_cluster_needs_a_shared_folder():
    session.require_local("local[4]")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            session.require_local(master)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_queries_run_from_another_folder(tmp_path):
    """A query with an Arrow function and a streaming one, with nothing but the entry file's place known."""
    code = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry_point", {os.path.join(ROOT, "__spark_entry__.py")!r})
e = importlib.util.module_from_spec(spec); spec.loader.exec_module(e)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
q = e.queries()
print("ROWS", q["feat_entropy"](spark, "/root/testdata/sf0.001").count(), q["st_filter_chunks"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "ROWS" in done.stdout, done.stderr[-2000:]


def test_scores_without_labels(spark):
    df = spark.createDataFrame([(None, 0.9), (1, 0.5), (0, 0.1)], "y_true int, y_prob double")
    assert ev.average_precision(df).first()[0] == 1.0


def test_url_keys_are_taken_literally(spark):
    from pyspark.sql import functions as F
    one = spark.range(1).select(triage.clean_url(F.lit("http://h/p?axb=1&a.b=2"), ["a.b"]).alias("u")).first().u
    assert one == "http://h/p?axb=1"

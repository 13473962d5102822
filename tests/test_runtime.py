import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from catalign import runtime
from catalign.runtime import checkpoint_root, global_rank, lookup, stage


def test_global_rank_is_the_same_in_one_task_and_in_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("k"), F.col("id").alias("v"))
    one = {r["k"]: r["n"] for r in global_rank(df, [F.col("k").desc()], "n").collect()}
    many = {r["k"]: r["n"] for r in global_rank(df, [F.col("k").desc()], "n", single_task_rows=100).collect()}
    assert one == many == {k: i for i, k in enumerate(sorted(one, reverse=True))}


def test_ranges_of_a_rank_are_no_more_than_the_cluster_has_tasks_for(spark):
    ranked = global_rank(spark.range(1000), [F.col("id")], "n", single_task_rows=2)
    assert len([f for f in ranked.inputFiles() if "/ranges-" in f]) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(r["n"] for r in ranked.filter("id = n").collect()) == list(range(1000))


def test_stage_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id int, v array<double>")
    back = stage(df)
    assert back.schema == df.schema and sorted(back.collect()) == sorted(df.collect())


def test_lookup_keeps_column_order(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "x int, k string")
    dim = spark.createDataFrame([("a", 9)], "k string, y int")
    joined = lookup(rows, dim, "k")
    assert joined.columns == ["x", "k", "y"] and sorted(map(tuple, joined.collect())) == [(1, "a", 9), (2, "b", None)]


class FakeConf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class FakeSession:
    def __init__(self, master, values):
        self.conf = FakeConf(values)
        self.sparkContext = self
        self.master, self.applicationId = master, f"app-{master}"

    def getConf(self):
        return self.conf

    def getCheckpointDir(self):
        return None


def test_checkpoint_folder_comes_from_the_session():
    assert checkpoint_root(FakeSession("spark://x", {"spark.checkpoint.dir": "s3://b/ck/"})) == "s3://b/ck"
    with pytest.raises(RuntimeError):
        checkpoint_root(FakeSession("spark://x", {}))
    assert checkpoint_root(FakeSession("local[2]", {})).startswith(runtime.tempfile.gettempdir())


def test_workers_find_the_package_wherever_the_session_starts(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("dbscan", "jaro_winkler_pairs"):
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "jaro_winkler_pairs" in done.stdout

"""The scratch folder."""

import os
import subprocess
import sys

import pytest

from mailloom.session import Documents, clear_scratch, shared_dir, spread, written


def test_scratch(spark):
    df = written(spark.range(10), "x")
    assert df.count() == 10 and shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() >= 4


def test_clearing(spark):
    path = written(spark.range(3), "y").inputFiles()[0]
    clear_scratch(spark)
    assert not os.path.exists(path.removeprefix("file://"))


ALONE = """
from mailloom.session import get_session, shared_dir, written
spark = get_session("local[2]", 2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert written(spark.range(5), "x").count() == 5 and shared_dir(spark) == shared_dir(spark)
assert spark.range(3).checkpoint().count() == 3
print("fine")
"""


def test_without_any_setting(tmp_path):
    """A fresh process, whose Spark has no configuration folder."""
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_CONF", "PYSPARK_SUBMIT"))} | {"SPARK_CONF_DIR": str(tmp_path), "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", ALONE], env=env, capture_output=True, text=True, timeout=120, check=False)
    assert "fine" in done.stdout, done.stderr[-2000:]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_documents(spark, tmp_path):
    docs = Documents(spark, f"file://{tmp_path}/d")
    assert not docs.exists("a.json")
    with pytest.raises(FileNotFoundError):
        docs.read("a.json")
    for text in ("first", "zweite ü"):
        docs.write("a.json", text)
        assert docs.exists("a.json") and docs.read("a.json") == text

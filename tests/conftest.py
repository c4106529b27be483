import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers import the package from the checkout in local mode.
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    session = (SparkSession.builder.master("local[*]")
               .appName("trafficgraph-tests")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.checkpoint.dir", os.path.join(scratch, "checkpoints"))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("tests.scratch", scratch)
    yield session
    session.stop()


@pytest.fixture()
def scratch(spark):
    return tempfile.mkdtemp(prefix="case-", dir=spark.conf.get("tests.scratch"))

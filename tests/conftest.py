import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    ckpt = tempfile.mkdtemp(prefix="domquarry-test-ckpt-")
    s = (SparkSession.builder.master("local[*]").appName("domquarry-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", ckpt)
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def pages_df(spark):
    def make(rows):
        return spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    return make


@pytest.fixture
def dom_of(pages_df):
    from domquarry.operators.nodes import build_dom
    from domquarry.plans.compile import Planner

    def make(rows):
        dom = build_dom(pages_df(rows), min_partitions=2, num_partitions=4)
        return dom, Planner(dom)
    return make

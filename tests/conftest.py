import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tidewatch.session import configure

    session = (
        SparkSession.builder.master("local[8]")
        .appName("tidewatch-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="shared-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def small_slices(spark):
    """Treat any key with more than a handful of rows as hot."""
    name = "spark.tidewatch.sliceRows"

    def limit(rows: int) -> None:
        spark.conf.set(name, str(rows))

    yield limit
    spark.conf.unset(name)

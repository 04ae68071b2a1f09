import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

import pytest  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from corpusloom.storage import drop_staged  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    # Workers start in this folder, so a task that needs the package's files fails here too.
    os.chdir(tmp_path_factory.mktemp("elsewhere"))
    os.environ.pop("PYTHONPATH", None)
    session = (
        SparkSession.builder.master("local[8]")
        .appName("corpusloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_staged(session)
    session.stop()

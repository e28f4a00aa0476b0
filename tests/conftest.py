"""One local session for all tests."""

import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    home = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    conf = {
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.driver.host": "127.0.0.1", "spark.local.dir": f"{home}/local", "spark.sql.warehouse.dir": f"{home}/warehouse",
        "spark.checkpoint.dir": f"file://{home}/shared",
    }
    session = SparkSession.builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return str(DATA)

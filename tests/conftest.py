import os

import pytest
from pyspark.sql import SparkSession

os.environ.setdefault("PYTHONPATH", "")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in os.environ["PYTHONPATH"].split(":"):
    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ['PYTHONPATH']}"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()

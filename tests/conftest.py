import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("millrace-tests").config("spark.sql.shuffle.partitions", "4").config("spark.default.parallelism", "4")
        .config("spark.sql.session.timeZone", "America/New_York").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "4").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df):
    """Rows of a DataFrame as sorted tuples."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))

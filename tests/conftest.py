import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from hyplab.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "hyplab-tests", shuffle_partitions=4)
    s.sparkContext.setLogLevel("OFF")
    return s


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate Column functions on literal text columns a and b."""

    def run(fn, a, b=None):
        row = spark.createDataFrame([(a, b)], "a string, b string")
        from pyspark.sql import functions as F

        return row.select(fn(F.col("a"), F.col("b")).alias("x")).first()["x"]

    return run

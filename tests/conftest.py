import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from inkgauge.session import local_session

    s = local_session(8, "tests", "6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over a one-row frame."""
    from pyspark.sql import functions as F

    def value(expr, **columns):
        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]) if columns else spark.range(1)
        return df.select(expr.alias("x")).first()["x"]

    return value

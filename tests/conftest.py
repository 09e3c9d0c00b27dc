import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from inclusio.session import get_spark
    s = get_spark(master="local[4]", app="inclusio-tests", shuffle_partitions=4)
    yield s
    s.stop()


def col_values(spark, fn, values, dtype="string"):
    """Evaluate a Column function over a one-column frame, in input order."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]

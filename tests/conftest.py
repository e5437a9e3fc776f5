import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pagemill.session import get_session

    s = get_session(master="local[4]", shuffle_partitions=4, app="pagemill-tests")
    yield s
    s.stop()


def one(spark, expr_col, **cols):
    """Evaluate a Column expression over a one-row DataFrame built from ``cols``."""
    if cols:
        names = list(cols)
        df = spark.createDataFrame([tuple(cols[n] for n in names)], ", ".join(f"{n} string" for n in names))
    else:
        df = spark.range(1)
    return df.select(expr_col.alias("v")).collect()[0]["v"]

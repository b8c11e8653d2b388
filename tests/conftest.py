import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

DATA = os.environ.get("KINETABLE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from kinetable.session import local_session

    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import oracle

    return oracle.connect(data)


@pytest.fixture
def small_segments(spark):
    """Cut episodes every 7 frames, take groups above 10 rows as hot and no table as small."""
    spark.conf.set("spark.kinetable.broadcastRows", "0")
    spark.conf.set("spark.kinetable.segmentRows", "7")
    spark.conf.set("spark.kinetable.maxGroupRows", "10")
    yield
    spark.conf.unset("spark.kinetable.broadcastRows")
    spark.conf.unset("spark.kinetable.segmentRows")
    spark.conf.unset("spark.kinetable.maxGroupRows")

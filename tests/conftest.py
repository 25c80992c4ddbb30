import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from quorum.session import get_spark
    s = get_spark("local[4]", app="quorum-tests", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def T(day: int, sec: int = 0) -> dt.datetime:
    """A test timestamp: 2024-01-<day> plus ``sec`` seconds."""
    return dt.datetime(2024, 1, day) + dt.timedelta(seconds=sec)


def registry_df(spark, rows):
    """rows: (data_type, name, description, model_type, registered_at, width, mean, std, thr, ord)"""
    from quorum import schemas
    return spark.createDataFrame(rows, schemas.REGISTRY)


def measurements_df(spark, rows):
    """rows: (event_id, ts, data_type, utilization, label)"""
    from quorum import schemas
    return spark.createDataFrame(rows, schemas.MEASUREMENTS)


def config_df(spark, rows):
    from quorum import schemas
    return spark.createDataFrame(rows, schemas.CONFIG)

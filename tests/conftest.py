import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from netquarry.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", app="tests", memory="6g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Build a frame from rows and DDL."""
    return lambda rows, ddl: spark.createDataFrame(rows, ddl)


def ts(seconds, base=1_700_000_000):
    from datetime import datetime, timezone

    return datetime.fromtimestamp(base + seconds, tz=timezone.utc)

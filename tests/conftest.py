import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from foldguard.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # Many small partitions: groups and ranks are cut across them.
    session = local_session("tests", 8, spark__sql__adaptive__coalescePartitions__enabled="false")
    session.conf.set("spark.sql.shuffle.partitions", "6")
    yield session
    session.stop()

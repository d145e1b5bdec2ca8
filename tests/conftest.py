import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cropline.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Small table from a schema text and rows."""

    def make(schema, rows):
        return spark.createDataFrame(rows, schema)

    return make

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from supplyloom.session import local_session

    session = local_session(4)
    yield session
    from supplyloom.sources.storage import release

    release(session)
    session.stop()


@pytest.fixture
def table(spark):
    """Build a small frame: table('a string, b double', rows)."""

    def make(schema, rows):
        return spark.createDataFrame(rows, schema)

    return make


def rows(df):
    """Rows as tuples in a stable order, nulls first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is not None, str(type(v)), v) for v in r])

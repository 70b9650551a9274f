import pytest

from tests.compare import session

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return session(4)


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def frame(spark):
    """A frame from tuples and a DDL schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)

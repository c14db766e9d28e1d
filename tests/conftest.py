import pytest

from pitlane.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("pitlane-tests", master="local[8]", shuffle_partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()

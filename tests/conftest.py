import pytest

from docloom.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()

"""One Spark session for all tests."""

import pytest

from lodestone import session


@pytest.fixture(scope="session")
def spark():
    s = session.local("4", shuffle=4, memory="3g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"

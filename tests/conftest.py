import pytest

from tests.session import spark_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return spark_session()


@pytest.fixture(scope="session")
def sf():
    return SMALL

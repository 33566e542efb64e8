import pytest

from quillon.session import session


@pytest.fixture(scope="session")
def spark():
    return session("tests", spark__sql__shuffle__partitions="4", spark__default__parallelism="4")

import pytest

from vaultlens.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "4")
    s.sparkContext.setLogLevel("ERROR")
    yield s

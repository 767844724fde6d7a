import pytest

from roomfold.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 4, driver_memory="20g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()

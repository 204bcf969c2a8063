import pytest

from folioworks.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores=4, memory="3g")
    yield session
    session.stop()

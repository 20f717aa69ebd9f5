import pytest

from lapsewise.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "8g", "tests")
    yield session
    session.stop()

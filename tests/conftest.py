import pytest


@pytest.fixture(scope="session")
def spark():
    from millrace.session import local_session

    s = local_session(4, 4, "8g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

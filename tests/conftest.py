import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gazette.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "gazette-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()

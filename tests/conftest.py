import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from visitframe.session import local_session

    session = local_session(int(os.environ.get("TEST_CPUS", "4")), "visitframe-tests")
    yield session
    session.stop()

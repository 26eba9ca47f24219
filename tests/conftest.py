"""One local session for all tests."""

import pytest

from mailloom.session import get_session


@pytest.fixture(scope="session")
def spark():
    return get_session("local[4]", 4)

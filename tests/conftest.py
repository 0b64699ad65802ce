import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from plumbrule.core.session import local_session

    session = local_session("8", 8, "plumbrule-tests")
    yield session
    session.stop()

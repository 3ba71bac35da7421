import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from memlake.session import local_session

    session = local_session(4, memory="4g", app="memlake-tests")
    yield session
    session.stop()

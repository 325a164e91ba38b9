import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT)]


@pytest.fixture(scope="session")
def spark():
    from ratemill.session import local_session

    session = local_session("4", partitions=4, memory="4g")
    yield session
    session.stop()

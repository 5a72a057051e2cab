import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from editlift.session import local_session

    session = local_session(8, shuffle_partitions=4, app="editlift-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SMALL

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from emberscan.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=8, memory="8g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    path = Path("/root/testdata/sf0.001")
    if not path.exists():
        pytest.skip("the shared test tables are not here")
    return str(path)

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sparkloom.runtime import build_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores="4", shuffle_partitions=4, memory="3g")
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()

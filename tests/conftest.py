import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from stockyard.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "stockyard-tests", "6g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()

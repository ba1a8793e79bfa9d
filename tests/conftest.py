import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from annolake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(shuffle_partitions=4)
    session.sparkContext.setLogLevel("OFF")
    return session

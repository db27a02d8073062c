import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from scholia.session import importable, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = importable(local_session(8))
    session.sparkContext.setLogLevel("ERROR")
    return session

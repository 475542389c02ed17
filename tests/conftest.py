import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from quillmark.session import get_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session(4, 4)
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()

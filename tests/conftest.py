import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session, ship
    from tidemark.staging import clean

    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    clean()
    session.stop()

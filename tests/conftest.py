import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from lumenframe.session import local_session
    from lumenframe.tables import ship_package

    session = local_session(8, 8, "6g")
    ship_package(session)
    yield session

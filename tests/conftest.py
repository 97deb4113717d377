import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from labelmill.session import build_session  # noqa: E402
from tests.harness import DATA, connect  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("labelmill-tests", "local[8]", 8, **{"spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("LABELMILL_SF", f"{DATA}/sf0.001")


@pytest.fixture(scope="session")
def duck(sf):
    return connect(sf)

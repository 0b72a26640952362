import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from screenfunnel.session import local_session

    session = local_session(
        8, "tests", **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"), "spark.driver.memory": "6g"}
    )
    yield session
    session.stop()

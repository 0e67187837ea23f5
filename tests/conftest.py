import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("STUDYLOOM_DRIVER_MEMORY", "6g")


@pytest.fixture(scope="session")
def spark():
    from studyloom.session import local_session

    s = local_session(4, shuffle_partitions=4, app="tests")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()

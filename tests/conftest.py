import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lectern.session import local_session

    s = local_session("4", memory="4g", partitions=4, name="lectern-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

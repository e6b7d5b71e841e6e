import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cohortlab.session import get_session
    s = get_session(master="local[4]", shuffle_partitions=4, app_name="cohortlab-tests")
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from prism.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="prism-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("PRISM_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture()
def tmp_dir(tmp_path):
    return str(tmp_path)

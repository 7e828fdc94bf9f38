import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tarmac.session import local_session

    session = local_session(cpus=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quadrille.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, shuffle_partitions=4, app="quadrille-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    return SF

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from catalog_engine.session import local_session
    os.environ.setdefault("CE_SCRATCH", tempfile.mkdtemp(prefix="ce-tests-"))
    s = local_session(4, shuffle_partitions=4, driver_memory="8g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("BIASLENS_SCRATCH", tempfile.mkdtemp(prefix="biaslens-tests-", dir="/tmp"))
    from biaslens.session import build_session
    s = build_session("local[*]", app="biaslens-tests", shuffle_partitions=8)
    yield s
    s.stop()

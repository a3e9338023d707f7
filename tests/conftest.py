import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from larder.session import ensure_checkpoint_dir, get_session
    s = get_session("local[4]", app="larder-tests", shuffle_partitions=8,
                    extra={"spark.sql.streaming.checkpointLocation":
                           tempfile.mkdtemp(prefix="larder-stream-", dir="/tmp")})
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="larder-test-", dir="/tmp")

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hitfeed.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", 8, app_name="hitfeed-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_log(spark):
    from hitfeed.fixtures import policy_log
    return policy_log(spark, SF_SMALL)


@pytest.fixture
def tmp_dir(spark):
    from hitfeed.session import scratch_path
    return scratch_path(spark, "test")

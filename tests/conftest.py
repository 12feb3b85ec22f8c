import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kindling.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, app="kindling-tests", shuffle_partitions=4, driver_memory="4g")
    yield s
    s.stop()


def rows(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cellscape.session import local_session

    return local_session(8, **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def tables():
    if not os.path.isdir(SMALL):
        pytest.skip("test tables are not installed")
    return SMALL

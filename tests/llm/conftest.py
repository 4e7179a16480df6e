import os

import pytest


@pytest.fixture(scope="session")
def con(tables):
    from check_queries import connect

    return connect(tables)


@pytest.fixture(scope="session")
def pages_sf():
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("test tables are not installed")
    return path

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from codesift.session import local_session

    s = local_session("*", shuffle_partitions=8, app="codesift-tests")
    yield s
    s.stop()


@pytest.fixture
def files_df(spark):
    def make(rows):
        return spark.createDataFrame(rows, "path string, content string")
    return make

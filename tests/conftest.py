import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from modelkeep.session import checkpoint_root, get_spark
    s = get_spark("local[4]", shuffle_partitions=8)
    checkpoint_root(s)  # tests set their own scratch checkpoint folder
    yield s
    s.stop()


@pytest.fixture()
def scratch(spark):
    from modelkeep.session import scratch_path
    return lambda name: scratch_path(spark, name)

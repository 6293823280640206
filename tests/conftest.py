import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from quillspark.session import get_spark

    return get_spark("local[4]", partitions=4)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"

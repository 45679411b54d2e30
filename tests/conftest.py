import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from panelforge.session import local_session

    os.environ.setdefault("BENCH_MEMORY", "4g")
    return local_session(4, **{"spark.sql.shuffle.partitions": "4"})


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    return SF

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from souk.session import local_session  # noqa: E402
from souk.sources.store import Store  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("*", "souk-tests", spark__sql__shuffle__partitions="4")


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


@pytest.fixture(scope="session")
def small():
    return SMALL

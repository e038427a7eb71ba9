import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from prefrank.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def tiny_groups(spark):
    """Force the strip path: a group of more than 40 rows counts as hot."""
    spark.conf.set("spark.prefrank.groupRows", "40")
    yield
    spark.conf.unset("spark.prefrank.groupRows")

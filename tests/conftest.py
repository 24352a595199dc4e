import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.run import session  # noqa: E402
from checks.shipping import ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session("8", partitions=4)
    ship_package(spark)
    return spark


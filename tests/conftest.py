import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyworks.operators.scan import SPLIT_SETTING
from tallyworks.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=[None, 3], ids=["whole", "cut"])
def split(spark, request):
    """Run a test with keys left whole and with keys of more than three rows cut into chunks."""
    if request.param:
        spark.conf.set(SPLIT_SETTING, str(request.param))
    yield request.param
    spark.conf.unset(SPLIT_SETTING)

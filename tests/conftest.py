import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from splitscope.session import local_session

    s = local_session("*", shuffle_partitions=8, app="splitscope-tests")
    yield s
    s.stop()


@pytest.fixture(autouse=True)
def eight_partitions(request):
    """Tests that change the number of shuffle partitions leave it as it was."""
    yield
    if "spark" in request.fixturenames:
        request.getfixturevalue("spark").conf.set("spark.sql.shuffle.partitions", 8)

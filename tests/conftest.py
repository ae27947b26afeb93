import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from errbound.session import build_session
    return build_session(8, "errbound-tests", shuffle_partitions=4)

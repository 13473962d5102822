import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from catalign.runtime import build_session, drop_stages  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores=8, **{"spark.sql.shuffle.partitions": "4"})
    yield session
    drop_stages(session)
    session.stop()

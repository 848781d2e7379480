import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tarn.session import build_session

    session = build_session(
        "tests", cores=4, memory="6g",
        **{"spark__sql__shuffle__partitions": "4",
           "spark__checkpoint__dir": f"file://{tmp_path_factory.mktemp('checkpoints')}",
           "spark__sql__warehouse__dir": str(tmp_path_factory.mktemp("warehouse"))},
    )
    yield session
    session.stop()

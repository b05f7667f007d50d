import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(HERE)]

from recordmill import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return get_session("tests", 8, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint"))})
def pytest_configure(config):
    config.option.tbstyle = "short"

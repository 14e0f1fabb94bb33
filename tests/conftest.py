import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from feedscope.session import build_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", master="local[8]", shuffle_partitions=4,
                      **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("OFF")
    ship_package(s)
    return s

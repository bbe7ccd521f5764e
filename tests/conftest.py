import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from proofmill.session import build_session
    s = build_session("tests", "local[8]", spark_sql_shuffle_partitions="8", spark_driver_memory="8g", spark_ui_enabled="false",
                      spark_ui_showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

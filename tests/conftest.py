import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from linkwright.plans.runtime import build_session

    s = build_session(
        "tests",
        f"local[{os.environ.get('TEST_CPUS', '4')}]",
        **{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.driver.host": "127.0.0.1"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tidegauge.session import build_session
    from tidegauge.streaming.jobs import STATE_PROVIDER

    session = build_session("local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.sql.streaming.stateStore.providerClass": STATE_PROVIDER})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()

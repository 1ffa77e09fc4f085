import os

import pytest


@pytest.fixture(scope="session")
def spark():
    from lumenry.session import session

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    s = session("tests", "local[4]", **conf)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir("/tmp/checkpoints/tests")
    return s

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from retail_signal.session import get_spark
    s = get_spark("retail_signal_tests", master="local[4]", shuffle_partitions=4,
                  extra={"spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rs_test_ckpt_"))
    yield s
    s.stop()

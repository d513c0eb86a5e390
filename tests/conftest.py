"""One local session for all tests."""

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from homestead.session import local_session

    return local_session(8, **{"spark.sql.shuffle.partitions": "4", "spark.local.dir": tempfile.mkdtemp(prefix="spark-"), "spark.driver.memory": "6g"})

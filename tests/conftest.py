import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))   # for the Python workers


@pytest.fixture(scope="session")
def spark():
    from placelens.session import get_session
    session = get_session("tests", **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8",
                                      "spark.driver.memory": "8g",
                                      "spark.checkpoint.dir": tempfile.mkdtemp(prefix="placelens-tests-")})
    session.sparkContext.setLogLevel("ERROR")
    return session

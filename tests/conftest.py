import os
import sys
import tempfile

import pytest

TESTS = os.path.dirname(os.path.abspath(__file__))
ROOT = os.path.dirname(TESTS)
sys.path[:0] = [ROOT, TESTS]
# Python workers import the package (and test-defined encoders) by module name.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [ROOT, TESTS] + ([os.environ["PYTHONPATH"]] if os.environ.get("PYTHONPATH") else []))


@pytest.fixture(scope="session")
def spark():
    from shortlist.session import local_session
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    session = local_session("*", 8, checkpoint_dir=os.path.join(scratch, "checkpoints"),
                            **{"spark.ui.showConsoleProgress": "false",
                               "spark.sql.warehouse.dir": os.path.join(scratch, "warehouse")})
    yield session


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")

import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    from forumlens.session import get_session

    folder = tempfile.mkdtemp(prefix="forumlens-tests-")
    session = get_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="3g", spark__sql__warehouse__dir=f"{folder}/warehouse", spark__checkpoint__dir=f"file://{folder}/shared")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    if not SF.is_dir():
        pytest.skip("no test data")
    return str(SF)

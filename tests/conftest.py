import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TESTDATA = os.environ.get("WEBLOOM_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from webloom.session import build_session
    session = build_session("webloom-tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                            spark__ui__showConsoleProgress="false", spark__driver__memory="6g",
                            spark__checkpoint__dir=str(tmp_path_factory.mktemp("scratch")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return TESTDATA


@pytest.fixture(scope="session")
def con(folder):
    from tests.compare import connect
    return connect(folder)

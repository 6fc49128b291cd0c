import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF1 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from wordloom.session import build_session
    s = build_session("local[4]", 8, app="wordloom-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def docs1(spark):
    from wordloom.sources.tables import table
    return table(spark, SF1, "documents")

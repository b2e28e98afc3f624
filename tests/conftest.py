import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from verdant.session import build_session
    s = build_session("local[4]", 8, app_name="verdant-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_sf001():
    from oracle_compare import duck_connection
    return duck_connection(SF_ORACLE)

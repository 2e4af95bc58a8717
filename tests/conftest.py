import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from oracle import session

    found = session("4")
    yield found
    found.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables are not available")
    return SF_DIR


@pytest.fixture(scope="session")
def apps(spark, sf_dir):
    from riskframe.plans.fixtures import applications

    return applications(spark, sf_dir).cache()

"""Every registered query, against its SQL twin where there is one."""

import pytest
from oracle import compare, duck

from riskframe.plans.catalog import catalog

QUERIES = catalog()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, sf_dir, key):
    run, sql = QUERIES[key]
    assert compare(spark, con, sf_dir, run, sql) is None


def test_entry_file_lists_the_catalog():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.queries()["m01_auc"] is QUERIES["m01_auc"][0]

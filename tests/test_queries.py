"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import pytest

from provspark import catalog
from tests.compare import differences, views

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    if name in catalog.oracle_sql():
        assert differences(df, con, catalog.oracle_sql()[name]) == []
    else:
        assert df.collect()

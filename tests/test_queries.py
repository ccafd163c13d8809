"""Every registered query next to its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as driver
import check
from meshloom.plans.catalog import QUERIES
from meshloom.plans.oracles import ORACLES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["row", "col", "value"]
    assert not df.isEmpty()


def test_registry():
    """Every query of the mesh catalog has its SQL."""
    assert set(ORACLES) == set(QUERIES)
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    assert check.check(spark, SF_DIR, [name]) == 0

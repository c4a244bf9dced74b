"""Every query against its SQL in DuckDB on the smallest tables; the others for rows."""

from __future__ import annotations

import os

import pytest
from oracle import compare, connect

from ranklane.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.ORACLES:
        assert compare(df, con, catalogue.ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_flagship():
    assert catalogue.FLAGSHIP in catalogue.QUERIES

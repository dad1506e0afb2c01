"""Every SQL-expressible catalogue query equals its DuckDB statement at sf 0.01."""

import pytest

from tabsight.plans.catalog import ORACLES

from .conftest import SF_CHECK
from .oracle_compare import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF_CHECK)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, con, key):
    ok, msg = compare(spark, key, SF_CHECK, con)
    assert ok, msg

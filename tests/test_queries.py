"""Every query of the library's own against its SQL."""

from __future__ import annotations

import pytest

from compare import compare, connect
from conftest import SMALL
from floodlake import plans


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    assert compare(plans.QUERIES[name](spark, SMALL), con, plans.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert plans.QUERIES[name](spark, SMALL).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25

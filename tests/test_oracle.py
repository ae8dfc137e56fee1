"""Every registered query against its independent SQL."""

from __future__ import annotations

import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries
from grainwise.bindings.catalog import QUERIES as CATALOG
from tests.compare import difference, oracle_connection

QUERIES, ORACLE = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SMOKE_DIR)


def test_every_query_of_the_tables_has_an_oracle():
    assert set(CATALOG) <= set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_matches_oracle(spark, con, name):
    assert difference(QUERIES[name](spark, SMOKE_DIR), con, ORACLE[name]) is None


def test_entry(spark):
    assert entry(spark).columns == ["purchase_ym", "orders", "delivered_orders", "gmv"]

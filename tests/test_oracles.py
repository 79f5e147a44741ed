"""Every registered query against its DuckDB oracle on the sf0.001 tables
(exact values, order-insensitive) -- the driver's gate, run small."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracles.compare import compare, duck
from storepulse.plans.catalog import QUERIES as CATALOG
from tests.conftest import SF_SMALL

# the library's own operators; the corpus operators have their tests in tests/llm
QUERIES = {k: v for k, v in queries().items() if k in CATALOG}
ORACLES = {k: v for k, v in oracle_sql().items() if k in CATALOG}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_key_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.columns == ["product_name", "category", "total_quantity_sold", "total_revenue",
                          "sales_frequency", "avg_price"]
    assert df.count() == 10


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, con, key):
    problems = compare(QUERIES[key](spark, SF_SMALL), con, ORACLES[key])
    assert not problems, problems

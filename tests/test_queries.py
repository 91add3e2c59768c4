"""Every registered query against its SQL text: columns, types, row count and all values."""

import oracle
import pytest

import __spark_entry__ as contract
from gridloom.plans import REGISTRY


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_matches_sql(name, spark, sf_dir, duck):
    query = REGISTRY[name]
    assert query.sql is not None
    assert oracle.compare(query.run(spark, sf_dir), duck, query.sql) == []


def test_contract(spark):
    assert contract.oracle_sql().keys() <= contract.queries().keys()
    assert REGISTRY.keys() <= contract.oracle_sql().keys()
    assert contract.entry(spark).count() > 0

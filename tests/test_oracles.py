import pytest

from quaylark.plans import registry
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_sql(spark, name):
    same(spark, name, registry.QUERIES[name], registry.ORACLES[name], "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.01")
    assert df.columns and len(df.collect()) > 0

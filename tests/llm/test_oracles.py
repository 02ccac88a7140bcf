import pytest

from quaylark.llm import registry
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_sql(spark, name):
    same(spark, name, registry.QUERIES[name], registry.ORACLES[name], "/root/testdata/sf0.001")

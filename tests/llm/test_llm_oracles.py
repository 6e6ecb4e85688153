import pytest
from oracle import compare, connect
from siftline.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_oracle(spark, name):
    d = "/root/testdata/sf0.01"
    assert compare(spark, name, registry.QUERIES[name], registry.ORACLE_SQL[name], d, connect(d)) == ""

"""Every registered query of the engine against its oracle, on the smallest tables."""

import os

import pytest
from oracle import compare, connect

from siftline.plans import bindings

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.mark.parametrize("name", sorted(bindings.ORACLE_SQL))
def test_query_matches_oracle(spark, con, name):
    assert compare(spark, name, bindings.QUERIES[name], bindings.ORACLE_SQL[name], D, con) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(bindings.QUERIES) <= set(__spark_entry__.queries())
    assert os.path.isdir(D)

"""Every registered query against its SQL; those without SQL must run."""

import pytest

import __spark_entry__
from auditlake.plans import registry
from tests.oracle import assert_same, connect

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, con, name):
    assert_same(registry.QUERIES[name](spark, SMALL), con, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    row = __spark_entry__.entry(spark).first()
    assert 0 <= row["auc"] <= 1
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

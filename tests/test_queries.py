"""Every query runs; those with SQL agree with it on the smallest tables."""

import pytest

from folioflow.plans import catalog

from conftest import SF, same_as_oracle

QUERIES, ORACLE = catalog.tables()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, oracle, name):
    same_as_oracle(spark, oracle, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0

"""Every registered query against its SQL on the smallest tables."""

import __spark_entry__ as entry
import pytest
from check_oracle import compare, connect
from querywarden.plans.oracle import oracle
from querywarden.plans.queries import REGISTRY

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_exact_query_has_sql():
    assert set(REGISTRY) - set(oracle()) == {"nearest_vector_bands"}  # its recall is measured in test_vectors
    assert set(ORACLE) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_result(spark, sf, con, name):
    assert compare(spark, con, sf, name, entry.queries()[name], ORACLE[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0

"""Every registered query of the engine against its SQL."""

import pytest

from symgraph.plans.queries import ORACLE_SQL, QUERIES

from .oracle import assert_equal, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    assert_equal(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], con)

"""Every registered query that has SQL gives the SQL's rows on the smallest tables; the others run."""

import pytest

from quarry.plans.catalogue import OPERATORS, QUERIES, SQL
from tests.compare import compare, duck


@pytest.fixture(scope="session")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, sf_dir, name):
    bad, n, _, _ = compare(spark, con, sf_dir, name, QUERIES[name], SQL[name])
    assert not bad
    assert n > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_ids_not_built_are_not_claimed():
    assert not {"ST09", "S11", "S17", "S22", "K05", "P05"} & {i for ids in OPERATORS.values() for i in ids}

"""Every registered query against its check SQL on the smallest tables."""

from __future__ import annotations

import pytest
from check_oracle import compare, duck
from conftest import SF

from sparklog.plans import oracle_sql, queries


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_check_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    _, problem = compare(spark, con, name, SF, queries()[name], oracle_sql()[name])
    assert not problem, problem

"""Every query of the catalog on the smallest tables: the same rows as its SQL, or else rows at all."""
from __future__ import annotations

import pytest

from lectern.plans import catalog
from tests.compare import SMALL, connect, rows_in, rows_of

MAY_BE_EMPTY: set = set()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, con, name):
    got = rows_of(catalog.queries()[name](spark, SMALL))
    if (sql := catalog.oracle_sql().get(name)) is not None:
        assert got == rows_in(con, sql)
    else:
        assert got[1] or name in MAY_BE_EMPTY


def test_names_are_lower_case_and_sql_has_queries():
    assert all(n == n.lower() for n in catalog.queries())
    assert set(catalog.oracle_sql()) <= set(catalog.queries())

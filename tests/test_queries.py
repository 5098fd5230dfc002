"""Every query of the library equals its SQL, or at least gives rows."""

from __future__ import annotations

import pytest

from oracle import connect, same
from platewise.plans.catalog import FLAGSHIP, ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


def test_contract():
    import __spark_entry__ as entry

    assert FLAGSHIP in QUERIES and set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    rows = QUERIES[name](spark, DATA).toPandas()
    assert len(rows)
    if name in ORACLES:
        assert same(rows, con.execute(ORACLES[name]).df())

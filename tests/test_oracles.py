"""Every registered query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from helpers import duck_rows, rows_of

from tidemark.plans import all_queries, all_sql


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(name, spark, small, duck):
    frame = all_queries()[name](spark, small)
    got = rows_of(frame)
    if name in all_sql():
        want = duck_rows(duck, all_sql()[name])
        assert got[0] == want[0]
        assert got[1] == want[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

"""Every core query against its SQL on the smallest tables; the others only have to give rows."""

import pytest

from sonolith.plans import emission, further, joins, noise, places, repair, scans, tables, tracks
from tests.conftest import SMALL, rows_of

PLANS = (repair, places, noise, tracks, tables, joins, further, emission, scans)
ALL = [(name, query, plan.SQL.get(name)) for plan in PLANS for name, query in plan.QUERIES.items()]


@pytest.mark.parametrize(("name", "query", "sql"), ALL, ids=[a[0] for a in ALL])
def test_query(spark, duck, name, query, sql):
    got = query(spark, SMALL).toPandas()
    if sql is None:
        assert len(got)
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_names_are_unique():
    names = [a[0] for a in ALL]
    assert len(names) == len(set(names))

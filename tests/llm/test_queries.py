"""The queries on texts and entities on the smallest tables: against their SQL where they have one."""

import pytest

from sonolith.llm import plans
from tests.conftest import SMALL, rows_of


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SMALL).toPandas()
    if name in plans.SQL:
        want = duck.sql(plans.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)
    assert not got.map(lambda x: x.tolist() if hasattr(x, "tolist") else x).astype(str).duplicated().any()

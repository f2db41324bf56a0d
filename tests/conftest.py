import glob
import os
import sys

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sonolith.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    """A value that both engines' results give alike."""
    if value is None or value is pd.NA or value != value:
        return "null"
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, bool):
        return str(value)
    return f"{float(value):.9g}" if isinstance(value, int | float) else str(value)


def rows_of(df) -> list[tuple]:
    """All rows of a pandas table, in an order of their own, columns by name."""
    columns = sorted(df.columns)
    return sorted(tuple(plain(v) for v in row) for row in df[columns].astype(object).itertuples(index=False))

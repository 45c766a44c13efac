"""Every registered query of the library against its SQL on the smallest tables."""

import numbers
import os

import duckdb
import pandas as pd
import pytest

from tests.conftest import DATA
from wordloom.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(frame: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if pd.isna(x):
            return None
        return f"{float(x):.6f}" if isinstance(x, numbers.Number) and not isinstance(x, bool) else str(x)

    columns = sorted(frame.columns)
    return sorted([tuple(map(cell, row)) for row in frame[columns].itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)

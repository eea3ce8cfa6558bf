"""Every registered query outside ``llm`` runs whole on the smallest tables, and gives the rows of its SQL."""

import glob
import os

import duckdb
import pytest

from lectern.plans import papers  # noqa: F401  (registers its queries)
from lectern.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(rows):
    """In an order of their own; numbers to nine places."""
    shown = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows]
    return sorted(shown, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_are_those_of_the_sql(spark, small, tables, name):
    got = QUERIES[name](spark, small)
    rows = [tuple(r) for r in got.collect()]
    if name in SQL:
        want = tables.sql(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})")
        assert sorted(got.columns) == sorted(tables.sql(SQL[name]).columns)
        assert plain(rows) == plain(want.fetchall())

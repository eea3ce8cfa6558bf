"""Where queries are registered, with SQL that DuckDB can run where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, ints: str = "", longs: str = ""):
    """Registers a function under its name; ``ints`` and ``longs`` are columns that the SQL is to cast."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            casts = [f"CAST({c} AS {kind}) AS {c}" for kind, names in (("INT", ints), ("BIGINT", longs)) for c in names.split()]
            SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})" if casts else sql
        return f

    return add

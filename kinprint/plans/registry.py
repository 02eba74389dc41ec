"""The registered queries of the engine, and the SQL that checks them.

Modules of queries register themselves here; importing this module loads them all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if plain SQL can answer it."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


from kinprint.plans import queries_groups, queries_pairs, queries_scan, queries_tables, queries_text  # noqa: E402, F401

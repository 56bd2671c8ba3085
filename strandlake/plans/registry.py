"""Names, operators covered and agreeing SQL of every query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name; ``covers``: the operators it shows; ``sql``: DuckDB's equivalent."""

    def keep(f):
        key = name or f.__name__
        QUERIES[key], COVERS[key] = f, covers
        if sql:
            ORACLES[key] = sql
        return f

    return keep

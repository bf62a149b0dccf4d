"""Registry of the engine's queries and of their SQL equivalents."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Adds a query under ``name``; ``sql`` is what DuckDB must agree with."""

    def add(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add

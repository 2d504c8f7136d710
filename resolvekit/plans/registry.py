"""The registered queries, by name, and DuckDB's SQL for those that have one."""

from __future__ import annotations

from .inputs import duck

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = duck(sql)
        return f

    return register

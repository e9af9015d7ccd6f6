"""Name → query and name → SQL, gathered from the query modules."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) → DataFrame, with its SQL twin if it has one."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add

"""name -> (query, SQL); SQL is None where it can't say the same."""

from __future__ import annotations

REGISTRY: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def put(f):
        REGISTRY[name] = (f, sql)
        return f

    return put

"""Decorator that files a query under its function's name."""

from __future__ import annotations


def register(queries: dict[str, tuple]):
    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = (f, sql)
            return f

        return add

    return query

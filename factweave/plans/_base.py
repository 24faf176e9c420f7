"""Registration of queries with their SQL."""

from __future__ import annotations


class Book:
    """The queries of one module."""

    def __init__(self) -> None:
        self.QUERIES, self.SQL = {}, {}

    def query(self, sql: str | None = None):
        def add(f):
            self.QUERIES[f.__name__] = f
            if sql:
                self.SQL[f.__name__] = sql
            return f

        return add

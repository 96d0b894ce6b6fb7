"""A tiny registry: ``@query(name, sql)`` files a Spark query next to its SQL."""

from __future__ import annotations

from atlasmill.sources.fixtures import Views


class Area:
    def __init__(self):
        self.queries = {}
        self.sql = {}

    def add(self, name: str, build, sql: str | None = None) -> None:
        """``build`` takes the ``Views`` of a directory and returns a DataFrame."""
        assert name not in self.queries, name
        self.queries[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
        if sql is not None:
            self.sql[name] = sql

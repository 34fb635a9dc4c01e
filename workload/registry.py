"""Where queries register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.views import SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register a query; ``views`` names the derived tables its SQL reads, ``sql`` is the rest of it."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            body = sql.strip()
            parts = [SQL[v].strip() for v in views.split()]
            if body.upper().startswith("WITH "):
                parts.append(body[5:])
                ORACLES[name] = "WITH " + ",\n".join(parts)
            else:
                ORACLES[name] = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
        return fn
    return add

"""Named queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c):
    """Doubles are rounded to 6 digits on both sides: sums over a shuffle are not bit-stable."""
    from pyspark.sql import functions as F

    return F.round(c, 6)

"""All registered queries of the panel library and their DuckDB oracles."""

from __future__ import annotations

from .plans import factors, joins, lakes, live, market, portfolios, selection, stream, studies, tables, toplists, zones  # noqa: F401
from .plans.catalog import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)

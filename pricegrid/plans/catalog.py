"""Named queries over the driver's tables, and their DuckDB equivalents."""

from __future__ import annotations

from . import charts, configuration, decisions, execution, market, operations, research, stores, trading, validation

# the modules share one register
assert charts.query is configuration.query is decisions.query is execution.query is stores.query is trading.query is research.query is operations.query is validation.query is market.query
QUERIES: dict = market.QUERIES
ORACLE_SQL: dict[str, str] = market.ORACLE_SQL

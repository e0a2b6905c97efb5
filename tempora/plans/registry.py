"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from tempora.plans import composite_queries, function_queries, metric_queries, summary_queries

_MODULES = [metric_queries, summary_queries, function_queries, composite_queries]
QUERIES = {name: f for module in _MODULES for name, f in module.Q.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.SQL.items()}

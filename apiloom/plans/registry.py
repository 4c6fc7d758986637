"""All registered queries of the reference operators, with their SQL."""

from __future__ import annotations

from apiloom.plans import capability_queries, extra_queries, function_queries, graph_queries, metric_queries, profile_queries, run_queries, select_queries

_MODULES = [run_queries, metric_queries, select_queries, graph_queries, profile_queries, capability_queries, extra_queries, function_queries]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}

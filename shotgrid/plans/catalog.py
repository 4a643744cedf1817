"""All registered queries: name -> Spark plan, and name -> DuckDB oracle SQL."""

from __future__ import annotations

import importlib

_MODULES = ["q_pairs", "q_report", "q_signals", "q_models", "q_learn", "q_descent"]


def _load():
    queries, sql = {}, {}
    for m in _MODULES:
        mod = importlib.import_module(f"shotgrid.plans.{m}")
        queries.update(mod.QUERIES)
        sql.update(mod.SQL)
    return queries, sql


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]

"""The queries of this subpackage: name -> callable, and name -> DuckDB SQL where SQL can
express the result."""

from __future__ import annotations

import importlib

_MODULES = ["ngramlm", "chat", "sharding", "packing", "cotrain", "simjoin", "langid", "rules", "secrets", "decontaminate",
            "feast", "align", "setsketch"]


def _load() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for m in _MODULES:
        mod = importlib.import_module(f"shotgrid.llm.{m}")
        queries.update(mod.QUERIES)
        sql.update(getattr(mod, "SQL", {}))
    return queries, sql


def queries() -> dict:
    return _load()[0]


def oracle_sql() -> dict:
    return _load()[1]

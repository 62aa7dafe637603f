"""Queries over the supplied tables, one for each operator."""

from __future__ import annotations

import importlib

#: Modules that register queries.
MODULES = ("market", "structure", "trades", "orders", "outcomes", "leaks", "stores", "landed", "streams", "accounts", "runs", "records")


def load() -> tuple[dict, dict]:
    """(queries, DuckDB SQL) of all modules."""
    from tidebar.plans.registry import ORACLE, QUERIES

    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return dict(QUERIES), dict(ORACLE)

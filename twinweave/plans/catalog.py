"""Name to query, and name to DuckDB SQL."""

from __future__ import annotations

import importlib

from twinweave.plans.registry import ORACLES, QUERIES

for _module in ("graph", "ranking", "stats", "values", "selection"):
    importlib.import_module(f"twinweave.plans.queries_{_module}")


def queries():
    return dict(QUERIES.items())


def oracle_sql():
    return dict(ORACLES)

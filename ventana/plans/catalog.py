"""All registered queries and their DuckDB oracles."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

MODULES = ["q_basic", "q_windows", "q_stats", "q_io", "q_learn", "q_published", "q_derived"]

for _m in MODULES:
    importlib.import_module(f"{__package__}.{_m}")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)

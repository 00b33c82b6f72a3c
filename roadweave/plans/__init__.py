"""Registered queries over the driver's tables and their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ("relational", "network", "details", "routes", "functions", "lanes")


def _modules():
    return [importlib.import_module(f"{__name__}.{m}") for m in MODULES]


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.SQL.items()}

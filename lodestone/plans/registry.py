"""All queries by name, and their SQL."""

from __future__ import annotations

import importlib

#: Modules of this package that have QUERIES and ORACLE_SQL.
MODULES = ["retrieval", "pages", "graphs", "crawl", "features", "statistics"]


def _all(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(importlib.import_module(f"lodestone.plans.{module}"), name)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE_SQL")

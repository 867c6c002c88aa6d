"""The registered queries and their SQL: modules that hold QUERIES, a callable and SQL (or None) by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("lab", "funding", "manuscripts", "projects", "references", "journals", "prose", "records")


def _all() -> dict:
    return {name: pair for m in MODULES for name, pair in import_module(f"veldspar.plans.{m}").QUERIES.items()}


def flagship(spark, sf_dir):
    """Spending by account, vendor and month in one pass."""
    return queries()["lab04_spend_everywhere"](spark, sf_dir)


def queries() -> dict:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}

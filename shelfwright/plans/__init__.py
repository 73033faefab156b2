"""Registered queries; importing the package loads every query module."""

from importlib import import_module

from shelfwright.plans.registry import all_queries, all_sql

for _module in ("shelf_metrics", "kpis", "planogram", "boxes", "matching", "lifecycle", "texts", "vectors", "execution", "reports", "sources", "streams", "layout"):
    import_module(f"shelfwright.plans.{_module}")

__all__ = ["all_queries", "all_sql"]

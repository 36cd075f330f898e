"""Registered queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from importlib import import_module

#: Modules of timberline.plans that register queries.
MODULES = ("split_queries", "forest_queries", "analysis_queries", "model_queries")


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"timberline.plans.{m}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")


def entry(spark, sf_dir: str):
    """The flagship: the best oblique split of each projection by the Gini criterion."""
    return queries()["split_gini_oblique"](spark, sf_dir)

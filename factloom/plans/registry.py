"""Loads every query module and hands out the catalogue."""

from __future__ import annotations

import importlib

from factloom.plans.catalog import CATALOG, Query

MODULES = ("queries_facts", "queries_records", "queries_build", "queries_scores", "queries_streams")


def catalogue() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"factloom.plans.{module}")
    return CATALOG

"""All registered queries, gathered from the catalog modules."""

from __future__ import annotations

import importlib

from factloom.plans import registry

MODULES = ["catalog_tables", "catalog_relate", "catalog_search", "catalog_lifecycle", "catalog_corpus", "catalog_other"]

for _name in MODULES:
    importlib.import_module(f"factloom.plans.{_name}")


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    return dict(registry.ORACLES)

"""Loads every query module so that the catalog is complete."""

from __future__ import annotations

import importlib

from loanlens.plans.catalog import REGISTRY, Query

MODULES = [
    "loanlens.plans.queries_core",
    "loanlens.plans.queries_eval",
    "loanlens.plans.queries_eda",
    "loanlens.plans.queries_attr",
    "loanlens.plans.queries_drift",
    "loanlens.plans.queries_requests",
    "loanlens.plans.queries_model",
    "loanlens.plans.queries_trees",
    "loanlens.plans.queries_stream",
]


def all_queries() -> dict[str, Query]:
    for m in MODULES:
        importlib.import_module(m)
    return dict(REGISTRY)

"""Every operator as a runnable query over the given tables."""

from __future__ import annotations

import importlib

from shiftwise.plans import catalog

MODULES = ["prep_queries", "profile_queries", "two_sample_queries", "error_queries", "prototype_queries", "window_queries", "cluster_queries", "model_queries", "stream_queries"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"shiftwise.plans.{name}")


def all_queries():
    _load()
    return dict(catalog.QUERIES)


def all_sql():
    _load()
    return dict(catalog.SQL)

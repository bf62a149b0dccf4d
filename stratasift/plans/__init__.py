"""Composed plans and the registry of queries."""

from __future__ import annotations

import importlib

#: Modules that register queries.
MODULES = ("corpus", "retrieval_eval", "gates_ops", "governance", "relational", "streams", "composed", "datasets", "building", "runtime", "files", "expressions", "audits", "indexes", "publishing", "extraction", "cycles", "answering", "approval", "evidence", "routing")


def _load():
    for name in MODULES:
        importlib.import_module(f"stratasift.plans.{name}")
    from . import catalog

    return catalog


def all_queries() -> dict:
    return dict(_load().QUERIES)


def all_sql() -> dict[str, str]:
    return dict(_load().SQL)

"""Registered queries, each beside the SQL that checks it."""

from __future__ import annotations

import importlib

_MODULES = ("ingest", "stats", "catalogue", "sheets", "audit", "ledger", "streams")


def load():
    """Import every suite module; return (queries, check SQL)."""
    from factloom.suite import registry

    for name in _MODULES:
        importlib.import_module(f"factloom.suite.{name}")
    return dict(registry.QUERIES), dict(registry.ORACLES)

"""Collects every query module and exposes the driver-facing dictionaries."""

from __future__ import annotations

import importlib

from . import catalog

# modules that register queries into ``catalog`` when imported
MODULES = ("q_activity", "q_text", "q_budget", "q_train", "q_source", "q_stream")


def _load():
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")


def queries() -> dict:
    _load()
    return dict(catalog.QUERIES)


def oracle_sql() -> dict:
    _load()
    return {k: v for k, v in catalog.ORACLE.items() if k in catalog.QUERIES}

"""Registered queries and their oracle SQL, gathered from the modules of this folder."""

from __future__ import annotations

import importlib
import pkgutil


def _modules():
    for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        yield importlib.import_module(f"{__name__}.{m.name}")


def queries() -> dict:
    out = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    out = {}
    for m in _modules():
        out.update(m.ORACLES)
    return out

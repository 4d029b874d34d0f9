"""All queries of the core with their SQL, gathered from this package's modules."""

from __future__ import annotations

import importlib
import pkgutil

import orrery.plans as plans

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

for _m in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
    if _m != "registry":
        _mod = importlib.import_module(f"{plans.__name__}.{_m}")
        QUERIES |= _mod.QUERIES
        ORACLE |= getattr(_mod, "ORACLE", {})

"""Queries of this subpackage and their SQL, gathered from its modules."""

from __future__ import annotations

import importlib
import pkgutil

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

for _m in sorted(m.name for m in pkgutil.iter_modules(__import__(__package__, fromlist=["x"]).__path__)):
    if _m.startswith("p") and _m[1:2].isdigit():
        _mod = importlib.import_module(f"{__package__}.{_m}")
        QUERIES |= _mod.QUERIES
        ORACLE |= getattr(_mod, "ORACLE", {})

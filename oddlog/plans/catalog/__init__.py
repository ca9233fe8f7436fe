"""Registered queries: every operator run over whole tables, with its SQL equivalent where there is one."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES

for _part in ("ingest", "fields", "profiles", "selection", "models", "detection", "streams"):
    import_module(f"{__name__}.{_part}")

__all__ = ["QUERIES", "ORACLES"]

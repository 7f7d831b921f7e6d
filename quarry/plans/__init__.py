"""Named queries over the test tables, and the SQL that each must agree with."""

from __future__ import annotations

from importlib import import_module

MODULES = ("timeline", "search", "people", "chunks", "attendance", "streams", "records", "services", "files", "pdfs", "stored")


def _all(name: str) -> dict:
    found: dict = {}
    for m in MODULES:
        found |= getattr(import_module(f"{__name__}.{m}"), name)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE_SQL")

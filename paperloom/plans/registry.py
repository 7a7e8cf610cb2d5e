"""All queries of the core, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

#: Modules of this package that define QUERIES and SQL.
MODULES = ["data_quality", "text_scoring", "search", "pipeline"]


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        part = getattr(import_module(f"paperloom.plans.{module}"), name)
        if clash := out.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= part
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")

"""The queries of the engine, by name, with the SQL that each is held against."""

from __future__ import annotations

from importlib import import_module

from dialex.plans.catalog import ORACLES, QUERIES

for _name in ("boards", "entities", "series", "audits", "texts", "relational", "landed", "kept", "requests"):
    import_module(f"dialex.plans.{_name}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

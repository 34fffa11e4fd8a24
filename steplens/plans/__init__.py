"""Queries over the step-indexed views, one for each operator."""

from __future__ import annotations

from importlib import import_module

from steplens.plans.registry import ORACLES, QUERIES

for _name in ("scans", "rows", "joins", "integrity", "profiles", "windows", "graphs", "drifts", "monitoring", "ranking", "models", "streams"):
    import_module(f"steplens.plans.{_name}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

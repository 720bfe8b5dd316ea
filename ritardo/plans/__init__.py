"""All registered queries. Importing a plan module registers its queries."""

from __future__ import annotations

from importlib import import_module

from ritardo.plans.registry import ORACLES, QUERIES

MODULES = (
    "ordering", "consensus", "matching", "catalog", "evaluation", "music", "shaping", "expression", "tempo", "mapping",
    "prediction",
)


def _load() -> None:
    for m in MODULES:
        import_module(f"ritardo.plans.{m}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict:
    _load()
    return dict(ORACLES)

"""Queries over the given tables, each next to its SQL twin."""

from importlib import import_module

MODULES = ("documents", "retrieval", "chunks", "catalog", "requests")


def load_all() -> None:
    for name in MODULES:
        import_module(f"docweave.plans.{name}")

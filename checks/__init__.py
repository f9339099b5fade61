"""Registered queries over the driver's tables and the SQL they must agree with."""

from importlib import import_module

AREAS = ("temporal", "rankings", "quality", "star", "evolution", "insights", "entities", "compare", "mapping", "grid", "files")


def register_all() -> None:
    for area in AREAS:
        import_module(f"checks.{area}")

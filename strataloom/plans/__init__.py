"""Queries over the given tables, one module for each family of operators."""

from importlib import import_module

FAMILIES = ("metrics", "profiles", "texts", "retrieval", "graphs", "reasoning", "cleaning", "validation", "lineage", "annotation", "catalog", "sources", "streams")


def load() -> None:
    for family in FAMILIES:
        import_module(f"strataloom.plans.{family}")

"""Registered queries and their oracle SQL, one module per family."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ["files_extract", "files_parse", "inventory", "configs", "agents", "workloads", "pipes", "live"]


def _merge(attribute: str) -> dict:
    merged: dict = {}
    for family in FAMILIES:
        part = getattr(import_module(f"codeharbor.catalog.{family}"), attribute)
        twice = merged.keys() & part.keys()
        if twice:
            raise ValueError(f"registered twice: {sorted(twice)}")
        merged.update(part)
    return merged


def all_queries() -> dict:
    return _merge("QUERIES")


def all_oracles() -> dict:
    return _merge("ORACLE")

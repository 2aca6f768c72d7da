"""The queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ["quality", "simhash", "store", "substring", "hosts", "suffix_array", "sharding", "decontaminate", "packing", "licences"]


def _gather(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(import_module(f"driftforge.llm.{module}"), name, {})
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracles() -> dict:
    return _gather("ORACLES")

"""All queries of the engine and their SQL twins, gathered from the modules that define them."""

from __future__ import annotations

from importlib import import_module

MODULES = ["operators.drift", "operators.distributions", "operators.divergence", "operators.matrices", "operators.pipeline", "operators.encoders", "operators.evaluation", "plans.suites", "plans.experience", "plans.workload", "plans.joinorder", "plans.shapes", "plans.explain", "plans.features", "plans.arms"]


def _gather(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(import_module(f"driftforge.{module}"), name, {})
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracles() -> dict:
    return _gather("ORACLES")

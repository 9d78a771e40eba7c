"""Registered queries, one module per part of the survey."""

from __future__ import annotations

import importlib

from dealscope.plans.registry import REGISTRY, Query

MODULES = ("analytics", "questions", "profiling", "types", "joins", "changes", "corpus", "logs", "sources")


def load_all() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"dealscope.plans.{module}")
    return dict(REGISTRY)

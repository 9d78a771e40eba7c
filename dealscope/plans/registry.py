"""The registered queries: a name, a plan and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    survey: str
    plan: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, survey: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` for the given SURVEY ids."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, survey, fn, sql)
        return fn

    return register

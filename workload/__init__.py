"""Registered queries over the given tables, with SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; its SQL equivalent runs on the same tables."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return register


def load_all() -> None:
    from . import (  # noqa: F401
        catalogue,
        cleaning,
        increments,
        quality,
        ranking,
        retrieval,
        tables,
        texts,
        understanding,
    )

"""Registry of named queries (Spark builder + optional DuckDB oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so that its queries register."""
    import importlib
    import pkgutil

    import tessera.plans as pkg

    for m in pkgutil.iter_modules(pkg.__path__):
        if m.name not in ("registry", "sqlparts"):
            importlib.import_module(f"tessera.plans.{m.name}")

"""Catalogue of runnable queries: name, inventory ids, Spark function and the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    run: Run
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        if name in CATALOG:
            raise ValueError(f"query {name} registered twice")
        CATALOG[name] = Query(name, ids, run, sql)
        return run

    return add


def load() -> dict[str, Query]:
    """Import every plan module and give the catalogue."""
    import importlib
    import pkgutil

    import bookweave.plans as package

    for module in sorted(m.name for m in pkgutil.iter_modules(package.__path__)):
        if module.endswith("_plans"):
            importlib.import_module(f"bookweave.plans.{module}")
    return CATALOG

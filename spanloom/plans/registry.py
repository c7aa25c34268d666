"""The queries of the trace operators, by name, with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import Tables

_FOUND: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}
_MODULES = ("graph_queries", "window_queries", "result_queries", "text_queries", "flow_queries", "more_queries", "source_queries")


def query(name: str, sql: str | None = None):
    """Register a function of the trace tables under ``name``."""

    def put(f: Callable[[Tables], DataFrame]):
        if name in _FOUND:
            raise ValueError(f"two queries are named {name}")
        _FOUND[name] = (f, sql)
        return f

    return put


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"{__package__}.{m}")


def _bound(f: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: _bound(f) for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: sql for k, (_, sql) in _FOUND.items() if sql}

"""Collects the registered queries of every family."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FAMILIES = (
    "q_sources",
    "q_frames",
    "q_fields",
    "q_series",
    "q_align",
    "q_references",
    "q_identify",
    "q_ev",
    "q_fleet",
    "q_diag",
    "q_labels",
    "q_streaming",
)
Query = Callable[[SparkSession, str], DataFrame]


class Family:
    """Queries and SQL twins of one operator family, filled by decorators."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return add


def _families() -> list[Family]:
    return [importlib.import_module(f"signalspark.plans.{m}").FAMILY for m in FAMILIES]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for f in _families():
        out.update(f.queries)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for f in _families():
        out.update(f.sql)
    return out

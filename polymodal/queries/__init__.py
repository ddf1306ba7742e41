"""The queries that this library answers on the test tables, each with the SQL that an independent engine runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import functions, graph, proofs, relational, search

_MODULES = (relational, functions, proofs, graph, search)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, (f, _) in m.CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in _MODULES for k, (_, sql) in m.CASES.items() if sql}

"""The named queries of the core, collected from the modules that define them (``QUERIES`` and ``SQL`` of each)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES: tuple[str, ...] = ("fieldmill.plans.pipeline_queries", "fieldmill.plans.selection_queries", "fieldmill.plans.mask_queries", "fieldmill.plans.report_queries", "fieldmill.plans.graph_queries", "fieldmill.plans.geometry_queries", "fieldmill.plans.io_queries", "fieldmill.plans.file_queries")


def collect(modules: tuple[str, ...] = MODULES) -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL twins; a name defined twice is an error."""
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for name in modules:
        module = importlib.import_module(name)
        for key, value in module.QUERIES.items():
            if key in queries:
                raise ValueError(f"query {key} is defined twice")
            queries[key] = value
        sql.update(module.SQL)
    return queries, sql

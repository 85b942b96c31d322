"""Registered queries of the engine and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalogue_workloads, retrieval_workloads, sync_workloads, workloads  # noqa: F401  the others add their queries to workloads


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(workloads.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(workloads.ORACLES)

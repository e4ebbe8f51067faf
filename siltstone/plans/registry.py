"""The registered queries of the table-analytics operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from siltstone.plans import fixtures, scans

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ["scans", "merges", "upkeep", "integrity", "tables", "further", "reports", "snapshot_tables"]
_ALL = {name: q for m in MODULES for name, q in import_module(f"siltstone.plans.{m}").QUERIES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.lookup(spark, sf_dir).select("file_id", "pos", "l_orderkey", "l_partkey", "fate")


def queries() -> dict[str, Query]:
    return {name: q[0] for name, q in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: fixtures.text(q[1]) for name, q in _ALL.items() if q[1]}

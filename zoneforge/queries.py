"""Registered queries of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from zoneforge import catalog
from zoneforge.catalog import composite, related, samples, spatial, stored  # noqa: F401


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.QUERIES["flagship"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)

"""All registered queries of the engine with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import masses, regions, service, shapes, site, solids, spatial

MODULES = (spatial, site, regions, masses, service, shapes, solids)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' points in the projected system."""
    return spatial.crs_to_utm32(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}

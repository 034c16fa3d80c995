"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import identity_queries, lead_queries, text_queries, time_queries, website_queries  # noqa: F401  they register themselves
from .catalog import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovered records matched against the pool: decisions by kind."""
    return QUERIES["j02_d02_w04_match_discovered"](spark, sf_dir).groupBy("kind").count()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

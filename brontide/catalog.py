"""All registered queries with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .queries import core, more, streams, temporal
from .queries.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship", "core", "more", "streams", "temporal"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["l1_flagship_hourly_mean"](spark, sf_dir)

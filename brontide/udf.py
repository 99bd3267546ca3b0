"""A registry of named functions: map, reduce, filter, aggregate, transform, trigger.

Everything built in is a Column expression; Python functions of users are
registered as vectorised pandas UDFs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAPS: dict[str, Callable[..., Column]] = {
    "identity": lambda v: v, "multiply": lambda v, x: v * x, "add": lambda v, x: v + x, "abs": F.abs, "clamp": lambda v, lo, hi: F.greatest(F.least(v, F.lit(hi)), F.lit(lo)),
}
REDUCES: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "product": F.product, "min": F.min, "max": F.max, "count": F.count, "mean": F.avg}
FILTERS: dict[str, Callable[[Column, float], Column]] = {
    "gt": lambda v, x: v > x, "gte": lambda v, x: v >= x, "lt": lambda v, x: v < x, "lte": lambda v, x: v <= x, "eq": lambda v, x: v == x, "neq": lambda v, x: v != x,
}


def aggregate(v: Column) -> Column:
    """sum, count, avg, min, max, population deviation and range, as one struct."""
    return F.struct(
        F.sum(v).alias("sum"), F.count(v).alias("count"), F.avg(v).alias("avg"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("stddev"),
        (F.max(v) - F.min(v)).alias("range"),
    )


def transform(df: DataFrame, rename: dict[str, str] | None = None, select: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    df = df.withColumnsRenamed(rename or {})
    df = df.select(*select) if select else df
    return df.drop(*exclude) if exclude else df


class Registry:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.known: dict[str, tuple[str, object]] = {}

    def register(self, name: str, kind: str, function, returns: str = "double") -> None:
        if kind not in ("map", "reduce", "filter", "trigger", "aggregate", "transform"):
            raise ValueError(f"unknown kind {kind}")
        if name in self.known:
            raise ValueError(f"{name} is registered")
        made = F.pandas_udf(function, returns) if kind in ("map", "filter", "reduce") else function
        if kind in ("map", "filter", "reduce"):
            self.spark.udf.register(name, made)
        self.known[name] = (kind, made)

    def update(self, name: str, function, returns: str = "double") -> None:
        kind = self.known.pop(name)[0]
        self.register(name, kind, function, returns)

    def unregister(self, name: str) -> None:
        self.known.pop(name)

    def invoke(self, name: str, *columns: Column) -> Column:
        return self.known[name][1](*columns)

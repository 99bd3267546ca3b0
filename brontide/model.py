"""Points as DataFrames: a metric, tags, a double value and a BIGINT nanosecond time.

Tags that are known when a table is bound are *promoted* to real columns, so that
filters on them reach the Parquet scan; other tags live in one MAP column.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NS = 1_000_000_000


@dataclass(frozen=True)
class Points:
    """A table of points.  ``tags`` maps a tag to the column that holds it; ``tag_map`` names a MAP column for the rest."""

    df: DataFrame
    tags: dict[str, str] = field(default_factory=dict)
    value: str = "value"
    ts: str = "ts"
    tag_map: str | None = None

    def tag(self, name: str) -> Column:
        """The tag as a nullable string (null: the point lacks it)."""
        if name in self.tags:
            return F.col(self.tags[name]).cast("string")
        return F.col(self.tag_map)[name] if self.tag_map else F.lit(None).cast("string")

    def where(self, condition: Column) -> Points:
        return replace(self, df=self.df.where(condition))

    def between(self, start: int | None, end: int | None) -> Points:
        """The half-open time range [start, end); None is unbounded."""
        out = self
        if start is not None:
            out = out.where(F.col(self.ts) >= F.lit(start))
        if end is not None:
            out = out.where(F.col(self.ts) < F.lit(end))
        return out

    def series_key(self, metric: str = "") -> Column:
        """metric|k=v,k=v with tags in order, those missing left out."""
        known = [F.when(self.tag(k).isNotNull(), F.concat(F.lit(f"{k}="), self.tag(k))) for k in sorted(self.tags)]
        parts = F.filter(F.array(*known), lambda x: x.isNotNull()) if known else F.array().cast("array<string>")
        if self.tag_map:
            entries = F.transform(F.map_entries(self.tag_map), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
            parts = F.array_sort(F.concat(parts, F.coalesce(entries, F.array().cast("array<string>"))))
        return F.concat(F.lit(metric + "|"), F.array_join(parts, ","))


def time_ns(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")) * 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> Points:
    """The events table as points with the tags event_type and user_id."""
    df = read(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value", "props", time_ns("ts").alias("ts"))
    return Points(df, {"event_type": "event_type", "user_id": "user_id"})


def sales(spark: SparkSession, sf_dir: str) -> Points:
    """Line items as points with the tags flag and status, valued by price."""
    df = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("value"), time_ns("l_shipdate").alias("ts")
    )
    return Points(df, {"flag": "flag", "status": "status"})


def from_map(df: DataFrame, tag_map: str = "tags", value: str = "value", ts: str = "ts") -> Points:
    return Points(df, {}, value, ts, tag_map)


def bucket(ts: Column, width: int, origin: int = 0) -> Column:
    """Start of the window of ``width`` that holds ``ts``; also right for times before the origin."""
    return ts - F.pmod(ts - F.lit(origin), F.lit(width))

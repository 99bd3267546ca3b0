"""Property graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written


def neighbours(edges: DataFrame, start: DataFrame, direction: str = "out") -> DataFrame:
    """Distinct (node, neighbour) of the nodes in ``start``."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"))
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"))
    either = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return either.join(start, "node", "left_semi").distinct()


def reach(edges: DataFrame, start: list, depth: int, kind: str | None = None) -> DataFrame:
    """(node, hops): nodes within ``depth`` out-edges, each at its fewest hops.

    A join and an anti-join per level; each level is written once, so that no level is
    computed again for the next, and nothing but whether it is empty reaches the driver.
    """
    spark = edges.sparkSession
    links = (edges.where(F.col("type") == kind) if kind else edges).select("src", "dst")
    seen = frontier = spark.createDataFrame([(x, 0) for x in start], "node long, hops int")
    for level in range(1, depth + 1):
        step = links.join(frontier, links["src"] == frontier["node"]).select(F.col("dst").alias("node")).distinct()
        frontier = written(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(level)), "level")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def topology(spans: DataFrame, service: str = "service", parent: str = "parent_id", span: str = "span_id", error: str = "error") -> DataFrame:
    """(caller, callee, calls, errors) of edges between different services."""
    up = spans.select(F.col(span).alias("_s"), F.col(service).alias("caller"))
    pairs = spans.select(F.col(parent).alias("_s"), F.col(service).alias("callee"), error).join(up, "_s").where("caller != callee")
    return pairs.groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col(error).cast("long")).alias("errors"))

"""Connected components of a link table, by distributed label spreading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, spread_join


def components(links: DataFrame, u: str, v: str) -> DataFrame:
    """(node, component): the smallest node that each node of ``links`` reaches.

    Each round takes the smallest label among the neighbours, then the label of
    that label (pointer jumping), so long chains need about a logarithm of their
    length in rounds.  Labels are written to the shared folder after each round,
    the ones before are deleted; nothing but a count of changes reaches the driver.
    A node that a third of all links share is dealt to many tasks.
    """
    edges = materialise(
        links.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a != b").union(links.select(F.col(v), F.col(u)).where(F.col(u) != F.col(v))).distinct(), "edges"
    )
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        near = spread_join(edges, labels.withColumnRenamed("node", "b"), "b", "a").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("other"))
        step = labels.join(near.hint("merge"), "node").select("node", F.least("component", "other").alias("to"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("next"))
        new = materialise(spread_join(step, jump, "to", "node").select("node", F.least("to", "next").alias("component"), "was"), "labels")
        discard(labels)
        changed = new.where("component != was").limit(1).count()
        labels = new.select("node", "component")
        labels._written = new._written
        if not changed:
            discard(edges)
            return labels

"""Set operations on keyed tables, deduplication, snapshots and versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import neighbours


def either(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left rows and the right rows whose key is new."""
    return left.unionByName(right.join(left.select(*keys), list(keys), "left_anti"))


def both(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys), list(keys), "left_semi")


def unless(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys), list(keys), "left_anti")


def distinct_points(df: DataFrame, keys: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """One row per key: the smallest by ``tie``."""
    row = F.min(F.struct(*tie, *[c for c in df.columns if c not in tie])).alias("_r")
    return df.groupBy(*keys).agg(row).select([F.col(f"_r.{c}").alias(c) for c in df.columns])


def repeated_values(df: DataFrame, keys: Sequence[str], window: int, value: str = "value", ts: str = "ts") -> DataFrame:
    """Without rows that repeat the previous value of their series within ``window``."""
    again = (F.col(f"_prev.{value}") == F.col(value)) & (F.col(ts) - F.col(f"_prev.{ts}") <= window)
    return neighbours(df, keys, ts, take=(value,)).where(~F.coalesce(again, F.lit(False))).drop("_prev")


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """(keys, change, old, new): added, removed and modified rows."""
    a, b = old.select(*keys, F.col(value).alias("old_value"), F.lit(1).alias("_a")), new.select(*keys, F.col(value).alias("new_value"), F.lit(1).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "modified")
    return a.join(b, list(keys), "full").withColumn("change", change).where("change is not null").drop("_a", "_b")


def merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: Sequence[str], value: str = "value", prefer: str = "ours") -> DataFrame:
    """Three-way merge; where both sides changed a row, ``prefer`` (ours, theirs, max or min) decides."""
    tag = lambda df, n: df.select(*keys, F.struct(F.col(value).alias("v")).alias(n))
    all_ = tag(base, "b").join(tag(ours, "o"), list(keys), "full").join(tag(theirs, "t"), list(keys), "full")
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    pick = {"ours": o, "theirs": t, "max": F.greatest(o, t), "min": F.least(o, t)}[prefer]
    chosen = F.when(o.eqNullSafe(b), t).when(t.eqNullSafe(b) | o.eqNullSafe(t), o).otherwise(pick)
    conflict = ~o.eqNullSafe(b) & ~t.eqNullSafe(b) & ~o.eqNullSafe(t)
    return all_.withColumn("_c", chosen).withColumn("conflict", conflict).where("_c is not null").select(*keys, F.col("_c.v").alias(value), "conflict")


def as_of(versions: DataFrame, keys: Sequence[str], at, version: str = "version_ts", op: str = "op", seq: str | None = None) -> DataFrame:
    """The rows as they were: the latest version of each key up to ``at``, unless it deletes."""
    order = F.struct(F.col(version), F.col(seq) if seq else F.lit(0))
    rest = [c for c in versions.columns if c not in keys]
    latest = versions.where(F.col(version) <= F.lit(at)).groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_v"))
    return latest.select(*keys, "_v.*").where(F.col(op) != "DELETE")


def top_k(df: DataFrame, keys: Sequence[str], by: Sequence, k: int) -> DataFrame:
    """The first k rows of each key in the given order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("rank") <= k)

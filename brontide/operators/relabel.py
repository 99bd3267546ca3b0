"""Rules on tags, in order: drop, keep, rename, replace, hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import short_hash


def _other_than(key: str):
    return lambda a, _: a != key


def _one_of(keys: list[str]):
    return lambda a, _: a.isin(*keys)


def relabel(df: DataFrame, rules: list[dict], tags: str = "tags", metric: str = "metric") -> DataFrame:
    """Each rule: action, key, and where needed to, pattern, replacement or keys; ``metric`` limits it to names by regex."""
    for rule in rules:
        t, key = F.col(tags), rule.get("key")
        without = lambda k, t=t: F.map_filter(t, _other_than(k))
        one = lambda k, v: F.map_from_arrays(F.array(F.lit(k)), F.array(v))
        has = F.map_contains_key(t, key) if key else None
        action = rule["action"]
        if action == "drop":
            new = without(key)
        elif action == "keep":
            new = F.map_filter(t, _one_of(rule["keys"]))
        elif action == "rename":
            new = F.when(has, F.map_concat(F.map_filter(without(key), _other_than(rule["to"])), one(rule["to"], t[key]))).otherwise(t)
        elif action == "hash":
            new = F.when(has, F.map_concat(without(key), one(key, short_hash(t[key])))).otherwise(t)
        elif action == "replace":
            new = F.when(has, F.map_concat(without(key), one(key, F.regexp_replace(t[key], rule["pattern"], rule["replacement"])))).otherwise(t)
        else:
            raise ValueError(f"unknown action {action}")
        df = df.withColumn(tags, F.when(F.rlike(F.col(metric), F.lit(rule["metric"])), new).otherwise(t) if "metric" in rule else new)
    return df

"""Structured Streaming: windows, joins, deduplication, patterns, alerts and sinks.

All functions take and give DataFrames, streaming or not; the watermark is the one
knob for late rows (allowed lateness plus disorder).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import bucket
from ..operators.series import PERIOD
from ..shared import shared_dir


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    # watermarks need times with a zone
    return stream.select([F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.simpleString() == "timestamp_ntz" else F.col(f.name) for f in schema])


def finish(stream: DataFrame, mode: str = "append", folder: str | None = None, name: str | None = None) -> DataFrame:
    """Runs a stream over all there is (availableNow), with a checkpoint, and gives the emitted rows.

    A second run under the same ``name`` goes on from the checkpoint.  ``append`` goes to Parquet files; ``complete`` and ``update`` rewrite the result
    of the last batch that had any (idempotent per batch).
    """
    spark = stream.sparkSession
    base = folder or shared_dir(spark)
    at = f"{base}/stream-{name or uuid.uuid4().hex}"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{at}/state")
    if mode == "append":
        query = writer.format("parquet").option("path", f"{at}/out").outputMode("append").start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def tumbling(df: DataFrame, ts: str, size: str, keys: Sequence[str], aggs: Sequence[Column], late: str = "0 seconds", slide: str | None = None) -> DataFrame:
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = df.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def session(df: DataFrame, ts: str, gap: str, keys: Sequence[str], aggs: Sequence[Column], late: str = "0 seconds") -> DataFrame:
    out = df.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def distinct(df: DataFrame, ts: str, keys: Sequence[str], late: str) -> DataFrame:
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def join_within(left: DataFrame, right: DataFrame, key: str, width: str, ts: str = "ts", late: str = "10 seconds", how: str = "inner") -> DataFrame:
    """Interval join of two streams: equal keys, times at most ``width`` apart; columns get left_ and right_, ts is the later time."""
    l = left.select([F.col(c).alias(f"left_{c}") for c in left.columns]).withWatermark(f"left_{ts}", late)
    r = right.select([F.col(c).alias(f"right_{c}") for c in right.columns]).withWatermark(f"right_{ts}", late)
    on = F.expr(f"left_{key} = right_{key} AND left_{ts} BETWEEN right_{ts} - INTERVAL {width} AND right_{ts} + INTERVAL {width}")
    how = {"left": "leftOuter", "right": "rightOuter", "full": "fullOuter"}.get(how, how)
    return l.join(r, on, how).withColumn("ts", F.greatest(f"left_{ts}", f"right_{ts}"))


def sequence(df: DataFrame, key: str, steps: Sequence[Column], within: int, ts: str = "ts", tie: str = "event_id", period: int = PERIOD) -> DataFrame:
    """Batch pattern matching: rows meeting the steps in order, others may lie between (skip till next match).

    One match for each row that meets the first step: for every further step the
    next row that meets it.  ``within`` counts from the first row.  (key, t0, t1, ...)
    """
    df = df.withColumn("_p", bucket(F.col(ts), period)).withColumn("_next", F.array().cast("array<bigint>"))
    after = Window.partitionBy(key, "_p").orderBy(ts, tie).rowsBetween(1, Window.unboundedFollowing)
    later = Window.partitionBy(key).orderBy("_p").rowsBetween(1, Window.unboundedFollowing)
    for k in range(len(steps) - 1, 0, -1):
        chain = F.when(steps[k] & F.col("_next").isNotNull(), F.concat(F.array(F.col(ts)), F.col("_next")))
        # what a later period offers first, one row a key and period; within a period the next row that meets the step
        heads = df.groupBy(key, "_p").agg(F.min_by(chain, F.when(chain.isNotNull(), F.struct(ts, tie))).alias("_h"))
        heads = heads.select(F.col(key).alias("_key"), F.col("_p").alias("_q"), F.first("_h", ignorenulls=True).over(later).alias("_h"))
        df = df.withColumn("_c", F.first(chain, ignorenulls=True).over(after))
        df = df.join(heads, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_p") == F.col("_q"))).withColumn("_next", F.coalesce("_c", "_h")).drop("_c", "_h", "_key", "_q")
    out = df.where(steps[0] & F.col("_next").isNotNull()).where(F.element_at("_next", -1) - F.col(ts) <= within)
    return out.select(key, F.col(ts).alias("t0"), *[F.element_at("_next", k).alias(f"t{k}") for k in range(1, len(steps))])


def sequence_stream(df: DataFrame, key: str, ts: str, step: str, n: int, within_s: float, late: str = "0 seconds") -> DataFrame:
    """Streaming pattern matching on an integer column ``step`` (0 .. n-1, or -1): one running match per key, kept in state.

    A key's state is one number and two times; it ends with a match or ``within_s`` after the first row.
    """

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, begun = state.get if state.exists else (0, 0.0)
        found = []
        rows = pd.concat(list(batches)).sort_values(ts) if not state.hasTimedOut else pd.DataFrame({ts: [], step: []})
        for t, s in zip(rows[ts], rows[step], strict=True):
            now = pd.Timestamp(t).timestamp()
            if at and now - begun > within_s:
                at = 0
            if s == at:
                begun = now if at == 0 else begun
                at += 1
                if at == n:
                    found.append((k[0], begun, now))
                    at = 0
        if at:
            state.update((at, begun))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(found, columns=["key", "begun", "ended"])

    kind = df.schema[key].dataType.simpleString()
    slim = df.withWatermark(ts, late).select(key, ts, step)
    return slim.groupBy(key).applyInPandasWithState(run, f"key {kind}, begun double, ended double", "at int, begun double", "append", GroupStateTimeout.NoTimeout)


def alert_states(df: DataFrame, keys: Sequence[str], bad: Column, hold: int, ts: str = "bucket") -> DataFrame:
    """Adds ``state``: ok, pending (bad for less than ``hold``), firing, or resolved (the first good row after firing)."""
    order = Window.partitionBy(*keys).orderBy(ts)
    marked = df.withColumn("_bad", bad).withColumn("_turn", F.when(F.lag("_bad").over(order).eqNullSafe(F.col("_bad")), 0).otherwise(1))
    island = marked.withColumn("_run", F.sum("_turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    since = F.col(ts) - F.min(ts).over(Window.partitionBy(*keys, "_run"))
    held = island.withColumn("_held", since)
    firing = F.col("_bad") & (F.col("_held") >= hold)
    lit = held.withColumn("_firing", firing)
    state = F.when(F.col("_firing"), "firing").when(F.col("_bad"), "pending").when(F.coalesce(F.lag("_firing").over(order), F.lit(False)), "resolved").otherwise("ok")
    return lit.withColumn("state", state).drop("_bad", "_turn", "_run", "_held", "_firing")


def slo(df: DataFrame, keys: Sequence[str], good: Column, target: float) -> DataFrame:
    """(keys, total, good, sli, used, remaining, violated)."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(good).alias("good"))
    sli = F.when(F.col("total") > 0, F.col("good") / F.col("total")).otherwise(1.0)
    used = (1 - sli) / (1 - target)
    return out.select(*keys, "total", "good", sli.alias("sli"), used.alias("used"), F.greatest(F.lit(0.0), (1 - used) * 100).alias("remaining"), (sli < target).alias("violated"))


def burn_rate(df: DataFrame, good: Column, target: float, factor: float, short: int, long: int, now: int, ts: str = "ts") -> DataFrame:
    """(short_burn, long_burn, alert): the budget's burn in two windows that end at ``now``; both must reach the factor."""
    burn = lambda w: (1 - F.count_if(good & (F.col(ts) >= now - w)) / F.greatest(F.count_if(F.col(ts) >= now - w), F.lit(1))) / (1 - target)
    recent = df.where((F.col(ts) >= now - max(short, long)) & (F.col(ts) < now))
    out = recent.agg(burn(short).alias("short_burn"), burn(long).alias("long_burn"))
    return out.withColumn("alert", (F.col("short_burn") >= factor) & (F.col("long_burn") >= factor))


def last_values(df: DataFrame, keys: Sequence[str], value: str = "value", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(ts, tie)).alias("value"))


CONDITIONS = {
    "above": lambda v, x: v > x, "below": lambda v, x: v < x, "eq": lambda v, x: v == x, "neq": lambda v, x: v != x, "absent": lambda v, _: v.isNull(),
}


def composite(latest: DataFrame, series: str, conditions: dict[str, tuple[str, str, float]], logic: str = "and") -> DataFrame:
    """One row: every condition (series, above|below|eq|neq|absent, threshold) on the latest values, and ``alert``, all (and), any (or) or none (not) of them."""
    value = lambda k: F.max(F.when(F.col(series) == k, F.col("value")))
    row = latest.agg(*[F.coalesce(CONDITIONS[op](value(k), x), F.lit(False)).alias(name) for name, (k, op, x) in conditions.items()])
    true = F.filter(F.array(*[F.col(n) for n in conditions]), lambda c: c)
    alert = {"and": F.size(true) == len(conditions), "or": F.size(true) > 0, "not": F.size(true) == 0}[logic]
    return row.withColumn("alert", alert)


def declared(latest: DataFrame, series: str, specs: list[dict], silenced: Sequence[str] = ()) -> DataFrame:
    """(name, severity, series, value, route) of declared alerts that fire: dicts with name, condition, threshold, and optionally match (a series),
    severity and routes {severity: receiver}; silenced names are left out."""
    fired = []
    for s in specs:
        if s["name"] not in silenced:
            rows = latest.where(F.col(series) == s["match"]) if "match" in s else latest
            level = s.get("severity", "warning")
            hit = rows.where(F.coalesce(CONDITIONS[s["condition"]](F.col("value"), s.get("threshold", 0.0)), F.lit(False)))
            fired.append(hit.select(F.lit(s["name"]).alias("name"), F.lit(level).alias("severity"), F.col(series).cast("string").alias("series"), "value", F.lit(s.get("routes", {}).get(level, "default")).alias("route")))
    if not fired:
        raise ValueError("no alert is left")
    return reduce(DataFrame.unionByName, fired)


class Pipeline:
    """From -> transform, filter, enrich, aggregate -> to; works on streams and tables alike."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    def transform(self, f: Callable[[DataFrame], DataFrame]) -> Pipeline:
        return Pipeline(f(self.df))

    def filter(self, condition: Column) -> Pipeline:
        return Pipeline(self.df.where(condition))

    def enrich(self, table: DataFrame, keys: Sequence[str]) -> Pipeline:
        return Pipeline(self.df.join(table, list(keys), "left"))

    def route(self, routes: dict[str, Column]) -> dict[str, DataFrame]:
        """Rows by the first condition that holds; the rest under 'other'."""
        choice = F.lit("other")
        for name, condition in reversed(routes.items()):
            choice = F.when(condition, name).otherwise(choice)
        tagged = self.df.withColumn("_route", choice)
        return {name: tagged.where(F.col("_route") == name).drop("_route") for name in [*routes, "other"]}

    def aggregate(self, ts: str, size: str, keys: Sequence[str], *aggs: Column, late: str = "0 seconds") -> Pipeline:
        return Pipeline(tumbling(self.df, ts, size, keys, aggs, late))

    @classmethod
    def build(cls, spec: dict, tables: dict[str, DataFrame]) -> DataFrame:
        """A pipeline as a dict: source, steps [{filter | select | with | join}], all in SQL expressions."""
        df = tables[spec["source"]]
        for step in spec.get("steps", []):
            if "filter" in step:
                df = df.where(step["filter"])
            elif "select" in step:
                df = df.selectExpr(*step["select"])
            elif "with" in step:
                df = df.selectExpr("*", *[f"{e} AS `{n}`" for n, e in step["with"].items()])
            elif "join" in step:
                df = df.join(tables[step["join"]], step["on"], step.get("how", "inner"))
            elif "aggregate" in step:
                df = df.groupBy(*step.get("by", [])).agg(*[F.expr(f"{e} AS `{n}`") for n, e in step["aggregate"].items()])
            else:
                raise ValueError(f"unknown step {step}")
        return df

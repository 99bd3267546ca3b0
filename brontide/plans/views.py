"""Materialised and continuous aggregates, their refresh and use, retention, dependencies."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang.durations import duration
from ..model import Points, bucket
from .query import Agg, TSQuery, plan


@dataclass
class View:
    """sum, count, min and max per window and tags: what every mergeable aggregate can be read from."""

    name: str
    source: str
    window: int
    group_by: list[str]
    where: dict | None = None
    fns: list[str] = field(default_factory=lambda: ["sum", "count", "min", "max"])


def build(view: View, p: Points, start: int | None = None, end: int | None = None) -> DataFrame:
    q = TSQuery(view.source, [Agg(f, f) for f in view.fns], where=view.where, start=start, end=end, window=view.window, group_by=view.group_by)
    return plan(q, {view.source: p})


def merge(view: View, old: DataFrame, delta: DataFrame) -> DataFrame:
    """Adds the aggregates of new rows to a view's; nothing old is read again."""
    how = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    return old.unionByName(delta).groupBy("bucket", *view.group_by).agg(*[how[f](f).alias(f) for f in view.fns])


def refresh(spark: SparkSession, view: View, p: Points, path: str, since: int | None = None) -> None:
    """Recomputes the days that hold new rows and overwrites these partitions only."""
    start = None if since is None else since - since % (86_400 * 10**9)
    day = F.to_date(F.timestamp_micros(F.floor(F.col("bucket") / 1000).cast("long")))
    out = build(view, p, start).withColumn("date", day)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def answers(view: View, q: TSQuery) -> bool:
    """Whether the view can stand for the source of the query: same source and filter, coarser windows, fewer tags, mergeable aggregates."""
    fits = bool(q.window) and q.window % view.window == 0 and not q.slide and not q.align
    edges = all(x is None or x % view.window == 0 for x in (q.start, q.end))
    return fits and edges and q.metric == view.source and q.where == view.where and set(q.group_by) <= set(view.group_by) and all(a.fn in ("sum", "count", "min", "max", "mean", "avg") and a.arg in ("value", "*") for a in q.aggs)


def answer(view: View, stored: DataFrame, q: TSQuery) -> DataFrame:
    """The query computed from the stored view."""
    rows = stored
    if q.start is not None:
        rows = rows.where(F.col("bucket") >= q.start)
    if q.end is not None:
        rows = rows.where(F.col("bucket") < q.end)
    how = {"sum": F.sum("sum"), "count": F.sum("count"), "min": F.min("min"), "max": F.max("max"), "mean": F.sum("sum") / F.sum("count"), "avg": F.sum("sum") / F.sum("count")}
    return rows.groupBy(bucket(F.col("bucket"), q.window).alias("bucket"), *q.group_by).agg(*[how[a.fn].alias(a.alias) for a in q.aggs])


def verify(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results hold the same rows."""
    return a.exceptAll(b.select(a.columns)).isEmpty() and b.select(a.columns).exceptAll(a).isEmpty()


def parse(text: str) -> tuple[str, View | str]:
    """CREATE CONTINUOUS AGGREGATE n AS SELECT ... | DROP CONTINUOUS AGGREGATE n | ALTER CONTINUOUS AGGREGATE n SET WINDOW d."""
    from ..lang import sql

    m = re.fullmatch(r"\s*(create|drop|alter)\s+continuous\s+aggregate\s+(\w+)(?:\s+as\s+(.*)|\s+set\s+window\s+(\S+))?\s*", text, re.I | re.S)
    if not m or (m[1].lower() == "create") != bool(m[3]) or (m[1].lower() == "alter") != bool(m[4]):
        raise ValueError("no continuous aggregate statement")
    verb = m[1].lower()
    if verb == "drop":
        return verb, m[2]
    if verb == "alter":
        return verb, View(m[2], "", duration(m[4]), [])
    q = sql.parse(m[3])
    return verb, View(m[2], q.metric, q.window or 60 * 10**9, q.group_by, q.where)


class Catalogue:
    """Continuous aggregates by name, kept as Parquet folders; statements create, drop, alter and refresh them, queries use what fits."""

    def __init__(self, spark: SparkSession, tables: dict[str, Points], folder: str) -> None:
        self.spark, self.tables, self.folder = spark, tables, folder
        self.views: dict[str, View] = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def execute(self, text: str) -> None:
        verb, what = parse(text)
        name = what if isinstance(what, str) else what.name
        if verb == "create":
            if name in self.views:
                raise ValueError(f"{name} exists")
            self.views[name] = what
        elif name not in self.views:
            raise ValueError(f"no aggregate {name}")
        elif verb == "drop":
            del self.views[name]
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
            return
        else:
            self.views[name] = replace(self.views[name], window=what.window)
        refresh(self.spark, self.views[name], self.tables[self.views[name].source], self.path(name))

    def stored(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name)).drop("date")

    def query(self, q: TSQuery) -> DataFrame:
        """Answered from the coarsest view that fits, else from the source."""
        fitting = [v for v in self.views.values() if answers(v, q)]
        if not fitting:
            return plan(q, self.tables)
        best = max(fitting, key=lambda v: v.window)
        return answer(best, self.stored(best.name), q)


class Cache:
    """Results of queries by text, kept for a time and dropped when their metric is written; at most ``size`` of them."""

    def __init__(self, size: int = 100, seconds: float = 60.0, clock=time.monotonic) -> None:
        self.size, self.seconds, self.clock = size, seconds, clock
        self.kept: dict[str, tuple[float, str, DataFrame]] = {}

    def get(self, text: str, metric: str, make) -> DataFrame:
        found = self.kept.pop(text, None)
        if found and self.clock() - found[0] <= self.seconds:
            self.kept[text] = found  # used last
            return found[2]
        if found:
            found[2].unpersist()
        self.kept[text] = (self.clock(), metric, make().persist())
        while len(self.kept) > self.size:
            self.kept.pop(next(iter(self.kept)))[2].unpersist()
        return self.kept[text][2]

    def invalidate(self, metric: str) -> None:
        for text in [t for t, x in self.kept.items() if x[1] == metric]:
            self.kept.pop(text)[2].unpersist()


def cycles(needs: dict[str, list[str]]) -> list[str] | None:
    """A cycle among views that read each other, or None."""
    done: set[str] = set()

    def walk(n: str, path: list[str]) -> list[str] | None:
        if n in path:
            return path[path.index(n) :] + [n]
        if n in done:
            return None
        for m in needs.get(n, []):
            if found := walk(m, [*path, n]):
                return found
        done.add(n)
        return None

    return next((c for n in needs if (c := walk(n, []))), None)


def downsample(p: Points, metric: str, width: int, fns: list[str], label: str) -> DataFrame:
    """Points of metrics metric:<label>:<fn>."""
    wide = plan(TSQuery(metric, [Agg(f, f) for f in fns], window=width), {metric: p})
    rows = F.explode(F.array(*[F.struct(F.lit(f"{metric}:{label}:{f}").alias("metric"), F.col(f).cast("double").alias("value")) for f in fns])).alias("r")
    return wide.select(F.col("bucket").alias("ts"), rows).select("r.metric", "ts", "r.value")


def retained(df: DataFrame, before: int, ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts) >= before)


def backfill(run, start: int, end: int, slice_: int) -> list[DataFrame]:
    """``run(a, b)`` for every slice of [start, end)."""
    return [run(a, min(a + slice_, end)) for a in range(start, end, slice_)]

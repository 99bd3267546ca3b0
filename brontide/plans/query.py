"""The logical query that all dialects share, and its DataFrame plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..model import Points, bucket
from ..operators import windows
from ..operators.filters import predicate
from ..operators.joins import asof
from ..operators.series import nearest_rank, neighbours


@dataclass
class Agg:
    fn: str
    alias: str
    arg: str = "value"
    param: float | None = None


@dataclass
class TSQuery:
    metric: str
    aggs: list[Agg] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    where: dict | None = None
    start: int | None = None
    end: int | None = None
    window: int | None = None
    slide: int | None = None
    group_by: list[str] = field(default_factory=list)
    fill: str | None = None
    max_gap: int | None = None
    align: str | None = None
    zone: str = "UTC"
    asof: str | None = None
    tolerance: int | None = None
    order_by: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None


FUNCTIONS = ("count", "sum", "mean", "avg", "min", "max", "first", "last", "stddev", "percentile", "rate", "median", "delta", "increase", "count_distinct")


def aggregate(agg: Agg, v: Column, ts: Column, order: Column) -> Column:
    fn = agg.fn
    if fn == "count":
        return F.count(v).cast("double")
    if fn == "rate":
        return A.plain_rate(v, ts, order)
    if fn in ("delta", "increase"):
        s = A.Steps(v, ts, F.col("_prev._v"), F.col("_prev._t"))
        return s.delta() if fn == "delta" else F.when(F.count(v) >= 2, s.counter_delta())
    simple = {
        "sum": F.sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "stddev": A.sample_stddev, "median": F.median, "count_distinct": F.count_distinct,
        "first": lambda x: A.first(x, order), "last": lambda x: A.last(x, order),
    }
    if fn not in simple:
        raise ValueError(f"unknown aggregate {fn}")
    return simple[fn](v)


def grouped(df: DataFrame, keys: list[Column], aggs: list[Agg], value, ts: Column, order: Column, tie: str | None) -> DataFrame:
    """One aggregate over the groups; exact percentiles, which need ranks, are joined to it."""
    names = df.select(*keys).columns
    ranked = [a for a in aggs if a.fn == "percentile"]
    plain = [a for a in aggs if a.fn != "percentile"]
    out = None
    if plain or not ranked:
        rows = df
        if any(a.fn in ("delta", "increase") for a in plain):
            rows = df.where(~F.isnan(value(plain[0]))).withColumns({n: k for n, k in zip(names, keys, strict=True)}).withColumns({"_t": ts, "_v": value(plain[0])})
            rows, keys = neighbours(rows, names, "_t", [tie] if tie else [], ["_v"]), [F.col(n) for n in names]
        out = rows.groupBy(*keys).agg(*[aggregate(a, value(a), ts, order).alias(a.alias) for a in plain])
    for a in ranked:
        own = nearest_rank(df.select(*keys, value(a).alias("_value")), names, "_value", a.param if a.param is not None else 95.0, a.alias)
        if out is None:
            out = own
        elif names:
            on = reduce(and_, [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names])
            out = out.alias("a").join(own.alias("b"), on, "left").select("a.*", f"b.{a.alias}")
        else:
            out = out.withColumn("_one", F.lit(1)).join(own.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
    return out.select(*names, *[a.alias for a in aggs])


def time_range(q: TSQuery, p: Points) -> Points:
    return p.between(q.start, q.end)


def plan(q: TSQuery, tables: dict[str, Points], tie: str | None = None) -> DataFrame:
    """Filters and columns first, so that both reach the scan; then windows, aggregates, filling, order and limit."""
    if q.metric not in tables:
        raise ValueError(f"unknown metric {q.metric!r}")
    p = time_range(q, tables[q.metric])
    if q.where:
        p = p.where(predicate(p, q.where))
    tags = {g: p.tag(g).alias(g) for g in q.group_by}
    if q.asof:
        other = tables[q.asof]
        shared = sorted(set(p.tags) & set(other.tags))
        left = p.df.select(*[p.tag(k).alias(k) for k in shared], F.col(p.ts).alias("ts"), F.col(p.value).alias("value"))
        right = other.df.select(*[other.tag(k).alias(k) for k in shared], F.col(other.ts).alias("ts"), F.col(other.value).alias("value"))
        out = asof(left, right, shared, ["value"], tolerance=q.tolerance)
        return ordered(q, out)
    if not q.aggs:
        names = [c for c in q.columns if c not in ("*", "value", "time", "timestamp")]
        wanted = names or (sorted(p.tags) if "*" in q.columns or not q.columns else [])
        out = p.df.select(F.col(p.ts).alias("ts"), *[p.tag(k).alias(k) for k in wanted], F.col(p.value).alias("value"))
        return ordered(q, out, [("ts", True), *[(k, True) for k in wanted]])
    ts, v = F.col(p.ts), F.col(p.value)
    df = p.df
    keys = list(tags.values())
    if q.window:
        if q.slide and q.slide != q.window:
            df = df.withColumn("_starts", F.explode(windows.hopping(ts, q.window, q.slide)))
            start: Column = F.col("_starts")
        elif q.align and q.align != "epoch":
            start = windows.calendar(ts, q.align, q.zone)
        else:
            start = bucket(ts, q.window)
        keys = [start.alias("bucket"), *keys]
    order = F.struct(ts, *([F.col(tie)] if tie else []))
    value = lambda a: F.lit(1) if a.arg == "*" else v if a.arg == "value" else p.tag(a.arg)
    out = grouped(df, keys, q.aggs, value, ts, order, tie)
    if q.fill and q.window:
        filled = [windows.gap_fill(out, q.group_by, q.window, a.alias, "bucket", q.fill, q.max_gap).drop("filled") for a in q.aggs]
        out = filled[0]
        for more in filled[1:]:
            out = out.join(more, ["bucket", *q.group_by])
    return ordered(q, out, [*([("bucket", True)] if q.window else []), *[(g, True) for g in q.group_by]])


def ordered(q: TSQuery, df: DataFrame, default: list[tuple[str, bool]] = ()) -> DataFrame:
    """Sorted only where someone asked for an order or a part of the rows; a bare sort of everything is no answer."""
    by = q.order_by or list(default)
    alias = {"time": "bucket" if "bucket" in df.columns else "ts"}
    if (q.order_by or q.limit or q.offset) and by:
        names = [(alias.get(c, c), up) for c, up in by]
        df = df.orderBy(*[F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in names])
    if q.offset:
        df = df.offset(q.offset)
    return df.limit(q.limit) if q.limit and q.limit > 0 else df
